import pytest

from voxtile.llm.sentences import Corpus, corpus_of, sentence_starts, sentences


def cut(text):
    at = sentence_starts(text)
    return [text[a:b].strip() for a, b in zip(at, [*at[1:], len(text)])]


@pytest.mark.parametrize(
    "parts",
    [
        ["Mr. Leranom vs. Mrs. Pezabek was the longest debate.", "Each reviewer stayed!"],
        ["The crew left at 9 p.m.", "The archive was closed."],
        ["The crew left at 9 p.m. and came back later.", "Why?", "Yes!"],
        ["“Is it still running?” asked B. Pestister.", "Reel no. 31, vol. 19, is missing."],
        ["They shouted “Louder!” and then “Stop!” twice.", "We... well, we waited for the light."],
        ["The ratio rose from .26 to 9.12 dB (approx. 59 per cent).", "(The second reel is blank.)", "The word ‘yes.’ was cut at 40.18 s.", "cuts-653.jsonl.gz was clipped."],
        ["He whispered, \"The light is on.\"", "Prof. D. L. Zupukuld joined from the N.W. studio."],
        ["Manche Laute, z. B. Husten, bleiben unmarkiert.", "Die Sitzung am 11. Mai begann pünktlich.", "Kabel, Bänder usw.", "Dr. Bripa prüfte Nr. 42 noch einmal."],
        ["« Arrêtez la bande ! » dit-elle.", "Certains sons, p. ex. la toux, restent."],
        ["¿Y el canal 59? no lo sé, dijo la operadora.", "La Dra. Nuhapusk revisó el n.º 36."],
        ["Архив собран в 1937 г. и не менялся.", "Кабели, плёнки и т. д.", "Записал И. К. Klustakox в студии.", "«Остановите плёнку!» — сказала она."],
        ["Ποιος έσβησε το σήμα;", "Ο κ. Siröseld μίλησε για 27,61 δευτερόλεπτα."],
        ["«أوقف الشريط!» قالت المهندسة.", "قال د. Mitokuss إن المدة 17.45 ثانية."],
        ["“टेप रोको!” उसने कहा।", "डॉ. Pabravem ने 0.83 सेकंड का नमूना चुना।"],
    ],
)
def test_spaced_scripts(parts):
    assert cut(" ".join(parts)) == parts
    assert cut("  \n" + "\n".join(parts) + "\n") == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["他说：“红灯亮了。”", "平均停顿是30.94秒，约18帧。", "“把录音停下！”她说。", "（第二盘是空的。）", "“可以了。”他点头说，“继续录。”", "我们……其实等了很久。"],
        ["彼の声（少し低い。）が残った。", "「赤いランプがついた。」と彼は答えた。", "現場チームは同じ区間を繰り返した…", "「テープを止めて！」と彼女は言った。"],
    ],
)
def test_unspaced_scripts(parts):
    assert cut("".join(parts)) == parts


def test_thai_spaces_and_numbers():
    assert cut("ค่าเฉลี่ยคือ 23.40 วินาทีต่อช่วง ขอบคุณมากค่ะ ใช้ไฟล์ take9.wav ได้เลย") == ["ค่าเฉลี่ยคือ 23.40 วินาทีต่อช่วง", "ขอบคุณมากค่ะ", "ใช้ไฟล์ take9.wav ได้เลย"]


def test_layouts():
    assert cut("Release plan\n1. It ran from Jan. to Oct. without a fault.\r\n- Why?") == ["Release plan", "1. It ran from Jan. to Oct. without a fault.", "- Why?"]
    assert cut("this corpus release missed it\nthe interviewer failed the checksum") == ["this corpus release missed it", "the interviewer failed the checksum"]
    wrapped = "The second half of reel 34 missed the overlap over the\ntelephone line? A volunteer from the choir sounded clean\nat roughly half the usual speed, said Prof.\nD. L. Zupukuld. It ended"
    assert [s[:12] for s in cut(wrapped)] == ["The second h", "A volunteer ", "It ended"]
    assert cut("A: Yes.\nB: No. Why?") == ["A: Yes.", "B: No.", "Why?"]


def test_degenerate():
    assert [sentence_starts(t) for t in (None, "", " \n\t", "​", "x", "…")] == [[], [], [], [], [0], [0]]
    long = "One two three. " * 20_000
    assert len(sentence_starts(long)) == 20_000


def test_operator_on_rows(spark):
    rows = [(k, "See Abc. the note, said Qrs. well. The end came. So it was." if k % 2 else None, 5) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, number int")
    assert sentences(df).count() == 90
    assert sentences(df.limit(0)).count() == 0


def test_the_document_itself_decides():
    # the stop of "Vollmbr." stands before a small letter once, so it ends nothing before a name either
    known = "The Vollmbr. was red. We asked the Vollmbr. Tarok again. It went well."
    assert cut(known) == ["The Vollmbr. was red.", "We asked the Vollmbr. Tarok again.", "It went well."]
    assert cut(known.replace("The Vollmbr. was", "The lamp was")) == ["The lamp was red.", "We asked the Vollmbr.", "Tarok again.", "It went well."]
    # what is written small elsewhere is no name and may open a sentence
    assert cut("The Vollmbr. was red. We asked the Vollmbr. Lamps went out. Two lamps stayed.")[1:3] == ["We asked the Vollmbr.", "Lamps went out."]
    # a listed word that ends a paragraph here is a plain word here
    assert cut("He trained his abs.\n\nHe has strong abs. Tarok rests.") == ["He trained his abs.", "He has strong abs.", "Tarok rests."]
    assert cut("He has strong abs. Now he rests.") == ["He has strong abs.", "Now he rests."]


def _corpus(spark, texts):
    return corpus_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_the_corpus_decides_where_the_document_is_silent(spark):
    plain = [f"The lamp {k} was on.\n\nThen the tape broke. Nobody saw the tape\n\nIt was the last tape." for k in range(60)]
    found = _corpus(spark, plain + [f"They met Qux. Tarok{k} early. They left." for k in range(40)] + [f"It took 40 mnt. and more, {k}." for k in range(40)])
    assert found.kinds["qux"] == "title" and found.kinds["mnt"] == "inner" and "tape" not in found.kinds
    assert found.openings["they"] is False or found.openings["then"] is False
    text = "We saw Qux. Tarok there. It rained."
    at = sentence_starts(text, found)
    assert [text[i : i + 2] for i in at] == ["We", "It"] and len(sentence_starts(text)) == 3


def test_lists_come_last(spark):
    """Without the lists hardly a boundary changes where the corpus has evidence; without the corpus many would."""
    names = ["Tarok", "Belun", "Mirak", "Sovel", "Gadrin", "Ulmek", "Pestar", "Zoruk"]
    lines = [f"Dr. {names[k % 8]} came at 9 p.m. and left.\n\nSee fig. {k} and vol. {k} of the notes. The tape ran on.\n\nThe tape was red. We met Prof. {names[k % 7]} and Mrs. {names[k % 5]} there.\n\nIt ran." for k in range(200)]
    found = _corpus(spark, lines)
    cuts = {(c, u): sum(len(sentence_starts(t, found if c else Corpus(), u)) for t in lines) for c in (True, False) for u in (True, False)}
    assert cuts[True, True] == cuts[True, False] == 200 * 6
    assert cuts[False, False] > cuts[True, True] + 600


def test_words_of_any_length_may_be_abbreviations():
    long = "Oberlandesger"
    assert cut(f"Das {long}. war voll. Im {long}. Tarok sprach man.") == [f"Das {long}. war voll.", f"Im {long}. Tarok sprach man."]


def test_each_part_of_a_text_keeps_the_rule_of_its_script():
    latin = ["The tape was started again after the second break and the", "crew stayed in the studio until the last reel was done."]
    chinese = ["现场小组在同一段录音里重复了三遍测试并且记录了全部的数值和时间以及每一个频道的编号还有所有设备的名称", "第二天早上他们又从头开始录制新的磁带并且检查了每一个频道的声音和电平以及所有设备的连接是否正常可用"]
    for k in (1, 30):
        assert cut("\n\n".join(["\n".join(latin)] * k + ["\n".join(chinese)])) == ["\n".join(latin)] * k + chinese
        assert cut("\n\n".join(["\n".join(chinese)] * k + ["\n".join(latin)])) == chinese * k + ["\n".join(latin)]
