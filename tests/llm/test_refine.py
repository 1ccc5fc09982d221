import re
from collections import defaultdict

from claimloom.llm.refine import formatting_copies


def brute(rows):
    groups = defaultdict(set)
    for scope, member, label in rows:
        if label is None or member is None:
            continue
        words = sorted(w for w in re.split(r"[\W_]+", label.upper().lower()) if w)
        if words:
            groups[scope, tuple(words)].add(member)
    return {(s, m, min(g), len(g)) for (s, _), g in groups.items() if len(g) > 1 for m in g}


def test_against_brute_force(spark):
    rows = [("a", f"m{i}", t) for i, t in enumerate(["Tax  Policy", "policy_tax", "(POLICY: tax)", "tax tax policy", "policy tax tax", "polic ytax", "plicoy tax", "", "  ", None, "...", "Straße", "STRASSE", "x" * 50_000, "X" * 50_000 + ".", "tax-policy"])]
    rows += [("b", "m0", "tax policy"), ("b", "m1", "tax"), ("a", "m0", "Tax  Policy"), ("a", None, "tax policy"), (None, "n0", "alone"), (None, "n1", "Alone!")]
    got = {tuple(r) for r in formatting_copies(spark.createDataFrame([(*r, 1, "c") for r in rows], "scope string, member_key string, label string, c1 int, key string")).collect()}
    assert got == brute(rows) and len(got) == 12


def test_hot_class_and_empty(spark):
    many = spark.range(30_000).selectExpr("'s' scope", "concat('m', lpad(cast(id as string), 6, '0')) member_key", "if(id % 2 = 0, 'Credit Rationing', 'rationing, credit') label")
    r = formatting_copies(many).selectExpr("count(*) n", "max(copies) c", "max(group_key) g").first()
    assert tuple(r) == (30_000, 30_000, "m000000")
    assert formatting_copies(many.limit(0)).count() == 0
