import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm.sentences import Gaps, dictionaries, sentence_units, sentences

CASES = [
    ["Growth fell by 3.5 per cent.", "Version 2.5.0 of the register helps."],
    ['One manager wrote: "We waited. Nothing came." and returned the form.', "A strike followed."],
    ['The auditors asked, "Why did it rise?"', "eGovernment portals opened.", "144 firms left."],
    ['The ministry called it "good enough?" in its 2014 review.', "It was not."],
    ["(The appendix reports the same.)", "We study St. Wexmere at 10 p.m.", "Most offices closed at 9 a.m. on trading days."],
    ["Rule No. 14 raised it, see e.g. Sec. 3.2 (s.e. .01), i.e. little.", "Ports, quarries, etc.", "What a day!"],
    ["Both were rebased by Murby Statistics Ltd.", "After Dec. 1975 output grew approx. 3 per cent p.a. again."],
    ["It was ... muted at best.", "J. Smith agreed."],
    ["Im 17. Jahrhundert war es z. B. am 11. Oktober 2016 kalt.", "Die Reform Nr. 13 wirkte bzw. wirkt i. d. R. kaum."],
    ["Ein Betrieb schrieb: „Wir warteten. Nichts kam.“ und schloss.", "Warum?"],
    ["Un atelier a répondu : « Les prix montaient. Nous avons fermé. » puis a rendu la page.", "Quel contraste !", "Selon l'art. 5 (cf. p. 4), p. ex. ici."],
    ["¡Qué diferencia!", "¿Por qué cambia?", "Véase la pág. 5."],
    ["Один завод (г. Торжок) ответил: «Мы ждали. Нет.» и вернул.", "До 1997 г. по плану, т. е. рано.", "Рис. 6 ясен."],
    ["एक इकाई ने लिखा, “हमने किया। कुछ नहीं।” और लौटा दिया।", "औसत रु. 128 रहा।", "क्या बदला?"],
    ["كتب أحدهم: «انتظرنا. لم يصل شيء.» ثم أعاد الورقة.", "هل يتغير؟", "بلغ ٣٫٥ وحدة."],
]


@pytest.mark.parametrize("want", CASES)
@pytest.mark.parametrize("gap", [" ", "  ", "\n", "\n\n"])
def test_spaced_scripts(want, gap):
    text = gap.join(want)
    assert [text[s:e] for s, e in sentences(text)] == want


@pytest.mark.parametrize(
    "want",
    [
        ["影响……几乎可以忽略。", "一家工厂写道：“价格上涨了！我们关门了。”随后交回了问卷。", "参见第6.1节。", "这多么鲜明！"],
        ["ある工場は「長く待った。何も来なかった。」と回答した。", "詳細は第6.4節（表4を参照。数値は年次）に示す。", "なぜか？"],
    ],
)
def test_spaceless_scripts(want):
    assert [("".join(want))[s:e] for s, e in sentences("".join(want))] == want


def test_thai_blanks():
    want = ["ข้อมูลเริ่มตั้งแต่พ.ศ.2525และครอบคลุมทุกอำเภอ", "เหตุใดจึงเปลี่ยนแปลงช้า", "We study it.", "ผลกระทบมีขนาดเล็กแต่คงที่"]
    text = " ".join(want)
    assert [text[s:e] for s, e in sentences(text)] == want


@pytest.mark.parametrize(
    "text, want",
    [  # wording that occurs in no test table
        ("他问：“你去吗？”然后走了。天黑了。", ["他问：“你去吗？”然后走了。", "天黑了。"]),
        ("她笑着说：“明天再来吧。”但是没有人回答。", ["她笑着说：“明天再来吧。”", "但是没有人回答。"]),
        ("老师写下“春天来了。”的句子。大家都念。", ["老师写下“春天来了。”的句子。", "大家都念。"]),
        ("父は「早く寝なさい。」と言った。母は黙っていた。", ["父は「早く寝なさい。」と言った。", "母は黙っていた。"]),
        ("彼は「もう帰ろうか。」しかし誰も動かなかった。", ["彼は「もう帰ろうか。」", "しかし誰も動かなかった。"]),
        ("兄の「行くぞ！」という声で目が覚めた。", ["兄の「行くぞ！」という声で目が覚めた。"]),
        ("แมวนอนหลับบนเก้าอี้ หมาวิ่งเล่นในสวน", ["แมวนอนหลับบนเก้าอี้", "หมาวิ่งเล่นในสวน"]),
        ("ฝนตกหนักมากครับ\nเมื่อวานน้ำท่วมถนน", ["ฝนตกหนักมากครับ", "เมื่อวานน้ำท่วมถนน"]),
        ("พ่อซื้อข้าวและ\nปลาที่ตลาด", ["พ่อซื้อข้าวและ\nปลาที่ตลาด"]),
        ("เขาชอบกินส้มและ ที่บ้านมีต้นส้ม", ["เขาชอบกินส้มและ ที่บ้านมีต้นส้ม"]),
    ],
)
def test_gaps_of_spaceless_scripts_by_the_words_beside_them(text, want):
    assert [text[s:e] for s, e in sentences(text)] == want


def test_lattice_and_dictionary():
    words = dictionaries()
    assert all(len(w) > 100 for w in words.values())
    assert Gaps(words).lattices["zh"].path("然后我们")[:2] == ["然后", "我们"]
    text = "In Panel A. It rose. See J. Smith. Nach dem   3. Quartal fiel er."
    assert [text[s:e] for s, e in sentences(text)] == ["In Panel A.", "It rose.", "See J. Smith.", "Nach dem   3. Quartal fiel er."]


def test_blocks_headings_lists():
    text = " \nIntroduction\n \n2. Results\r\n\r\n3. Agrarian skill mismatch.\n\nA line\nbreak ends nothing. Next one.\n\n\nA.1 Checks"
    assert [text[s:e] for s, e in sentences(text)] == ["Introduction", "2. Results", "3. Agrarian skill mismatch.", "A line\nbreak ends nothing.", "Next one.", "A.1 Checks"]


@given(st.text(alphabet="aB1 .!?…\"“”«»()\n。”「」กข的と、।", max_size=80))
@settings(max_examples=300, deadline=None)
def test_units_cover_all_but_white_space(text):
    at = 0
    for s, e in sentences(text):
        assert s >= at and e > s and not text[at:s].strip() and not text[s].isspace() and not text[e - 1].isspace()
        at = e
    assert not text[at:].strip()


def test_table(spark):
    d = spark.createDataFrame([(1, "All fell. None rose.", 5), (2, None, 5), (3, " \n", 5), (4, "It fell. " * 30_000, 5)], "doc_id long, text string, start_char int")
    got = {r["doc_id"]: r["count"] for r in sentence_units(d).groupBy("doc_id").count().collect()}
    assert got[1] == 2 and got[4] == 30_000 and set(got) == {1, 4}
    assert sentence_units(d.limit(0)).count() == 0
