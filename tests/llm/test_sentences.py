import pytest
from pyspark.sql import functions as F

from seqmill.llm import sentences as S


def cut(text, known=None):
    return [text[a:b] for a, b in S.sentence_spans(text, known)]


@pytest.mark.parametrize(
    "sentences",
    [
        ["Dr. Besk et al. found 3.5 hits, i.e. few, for No. 15.", "It was cold."],
        ["We used clay, moss, etc. as background.", "The tray held leaves, etc.", "The rest was lost."],
        ["The freezer was opened at 6 p.m.", "The tray was full.", "It began at 8:15 a.m. on Monday."],
        ["One leaf of this Fesobela sp. QLM-27 is left.", "Only one was left of this Fesobela sp.", "The grey matrix followed, and the rest."],
        ['"Is this the type?" asked T. Dell.', "Really?!", "What a day!"],
        ["The label says “it is late.” in ink.", 'The curator wrote: "It is late."', "The end came."],
        ["It had 4 columns... and then none.", "Nobody knows where it went...", "The end."],
        ["Der 3. Durchlauf lieferte z. B. 550 Treffer!", "Am 14. März kamen Farne usw.", "Die Blätter lagen dort.", "Auf dem Etikett steht: „Nur ein Blatt.“", "Es war spät."],
        ["L'étiquette dit : « Une seule feuille. »", "Quelle surprise !", "M. Dell vient, p. ex. sous le no. 39."],
        ["La nota decía: «Solo una hoja».", "¿Dónde está?", "¡Faltan 6!", "La Dra. Besk llegó."],
        ["Листья и т. д. хранились отдельно.", "Где лист?", "Образец собран в 1993 г. на склоне."],
        ["डॉ. Besk ने जाँच की।", "क्या यह है?", "हाँ।"],
        ["أين الورقة؟", "كُتب: «بقيت ورقة».", "نعم."],
        ["(See Table 1.)", "It was so."],
    ],
)
def test_scripts_with_blanks(sentences):
    assert cut(" ".join(sentences)) == sentences


@pytest.mark.parametrize(
    "sentences",
    [
        ["标签上写着：“只剩一片。”", "真奇怪！", "“它穿过了山坡。”是唯一的备注。", "不知去向……", "（参见表4。）", "馆长问：“是吗？”"],
        ["「葉は湿っていた。」とBeskは記録している。", "ラベルには「一枚」とある。", "見つからなかった……", "驚いた！"],
    ],
)
def test_scripts_without_blanks(sentences):
    assert cut("".join(sentences)) == sentences


def test_thai():
    assert cut("ป้ายเปียกพลาดเมล็ด ลำดับ YV4.1 มีความยาว 90 เบส ใบแคบ") == ["ป้ายเปียกพลาดเมล็ด", "ลำดับ YV4.1 มีความยาว 90 เบส", "ใบแคบ"]


def test_layout():
    text = "  Materials\n\nIt was\ncold. It was late.\n\n1. First item. More.\n2) Second item\n• Third."
    assert cut(text) == ["Materials", "It was\ncold.", "It was late.", "1. First item.", "More.", "2) Second item", "• Third."]


def test_document_decides():
    # "The" is written small elsewhere, so it begins a sentence; the name does not
    assert cut("He saw the group of B. The rest left.") == ["He saw the group of B.", "The rest left."]
    assert cut("He met B. Besk there.") == ["He met B. Besk there."]
    known = S.Knowledge(frozenset({"inst"}), frozenset({"the"}))
    assert cut("It went to the Inst. of Fen. Then it came.", known) == ["It went to the Inst. of Fen.", "Then it came."]


def test_cover_and_order():
    text = "A b. C d!\n\n e… F.G 5.5 (x. y) “q. r” 。。？ . . ...\t" * 50
    last = 0
    for a, b in S.sentence_spans(text):
        assert a < b and not text[last:a].strip() and text[a:b] == text[a:b].strip()
        last = b
    assert not text[last:].strip()


def test_operator(spark, monkeypatch):
    rows = [(1, "Aa bb. Cc dd.", 0), (2, None, 0), (3, " \n ", 0), (4, "", 0), (5, "Word here. " * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start_pos int")
    got = S.split_sentences(docs)
    assert got.where("doc_id < 5").orderBy("start_pos").collect() == [(1, 0, 6), (1, 7, 13)]
    assert got.where("doc_id = 5").count() == 5000
    assert S.split_sentences(docs.limit(0)).count() == 0
    monkeypatch.setattr(S, "is_small", lambda df: False)  # the join instead of the broadcast
    assert sorted(map(tuple, S.split_sentences(docs).collect())) == sorted(map(tuple, got.collect()))


def test_corpus_evidence_reaches_both_branches(spark, monkeypatch):
    learn = ["It lay in the inst. of fen, and the ab2. of moss, so besk went on."] * 6
    texts = ["He saw the Inst. Besk there.", "He saw the ab2. Moss there.", "It saw B. Then left.", "It was (Inst. Fen).It ended.", "X.Inst. Fen came."]
    rows = [(i, t) for i, t in enumerate(learn + ["It came. Then it left, then came."] * 6 + texts)] + [(None, "By the Inst. Fen it lay.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.word for r in S.corpus_evidence(docs).collect()}
    assert {"inst", "ab2", "then"} <= found
    got = sorted(map(repr, S.split_sentences(docs).collect()))
    plain = [S.sentence_spans(t) for t in texts]
    at = len(rows) - 1 - len(texts)
    have = [[(r.start_pos, r.end_pos) for r in S.split_sentences(docs).where(F.col("doc_id") == at + i).orderBy("start_pos").collect()] for i in range(3)]
    assert all(a != b for a, b in zip(have, plain))  # the corpus decides here
    monkeypatch.setattr(S, "is_small", lambda df: False)
    assert sorted(map(repr, S.split_sentences(docs).collect())) == got


def test_long_straight_quotation():
    text = 'They wrote "It was cold. ' + "The leaf lay in the old tray, and " * 60 + 'it was late." in the end. It was so.'
    assert len(text) > 2000 and cut(text) == [text[: -len(" It was so.")], "It was so."]


def test_branches_agree_over_the_whole_table(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for lists in ({}, {"before_more": frozenset(), "may_end": frozenset(), "before_ordinal": frozenset()}):
        got = sorted(map(tuple, S.split_sentences(docs, **lists).collect()))
        with monkeypatch.context() as m:
            m.setattr(S, "is_small", lambda df: False)
            assert sorted(map(tuple, S.split_sentences(docs, **lists).collect())) == got
        assert len(got) > 500


def known(texts, **lists):
    """What the corpus ``texts`` tell, without the lists."""
    counts = S.Counts()
    for t in texts:
        counts.add(t)
    rows = counts.rows().to_pylist()
    bits = {}
    for r in rows:
        flags = {bit: bool(f) for f, bit in S.findings(*[r[c] for c in S._COUNTS], lambda a, b: a and b, lambda a, b: a or b)}
        bits[r["word"]] = sum(b for b, f in flags.items() if f and (flags[S.ABBREVIATION] or b not in (S.ENDS, S.NEVER)) and b != S.ORDINARY)
    return S.Knowledge(findings=bits, before_more=frozenset(), may_end=frozenset(), before_ordinal=frozenset(), **lists)


def test_corpus_tells_titles_from_words_that_end_sentences():
    corpus = ["The leaf went on to Curat. Besk in the end. The tray lay with leaves, seeds, usuall. The rest lay by the usuall., as before."] * 6
    k = known(corpus)
    assert k.findings["curat"] & S.NEVER and k.findings["usuall"] & S.ENDS
    assert cut("It went to Curat. Dell there. It came.", k) == ["It went to Curat. Dell there.", "It came."]
    assert cut("It lay with moss, usuall. The tray fell.", k) == ["It lay with moss, usuall.", "The tray fell."]
    # of any length, and with a word in front for short numbers
    corpus = ["Es kam am 14. Marz und am 3. Juni, also sprach die handschriftl., neue Notiz, und so war es. Da lag es."] * 6
    k = known(corpus)
    assert k.findings["am #"] & S.ABBREVIATION and k.findings["handschriftl"] & S.ABBREVIATION
    assert cut("Es kam am 5. Mai. Da lag es.", k) == ["Es kam am 5. Mai.", "Da lag es."]


def test_document_is_asked_first():
    empty = S.Knowledge(before_more=frozenset(), may_end=frozenset(), before_ordinal=frozenset())
    # the comma shows the abbreviation, the capital inside a sentence the name, the small letter the common word
    text = "By the herbar., it lay, said old Besk of the leaves. The herbar. Besk kept it. It was in the herbar. Leaves fell."
    assert cut(text, empty)[1:] == ["The herbar. Besk kept it.", "It was in the herbar.", "Leaves fell."]
    # the corpus takes it for an abbreviation, the document shows it as a word
    k = S.Knowledge(abbreviations=["fen"])
    assert cut("The fen was cold. It lay in the fen. Besk came.", k) == ["The fen was cold.", "It lay in the fen.", "Besk came."]
    assert cut("It lay in the fen. Besk came.", k) == ["It lay in the fen. Besk came."]


def test_a_long_unit_takes_linear_time():
    import time

    def took(n):
        text = 'He said "so it is. ' * n + "It was cold. " * n
        began = time.process_time()
        S.sentence_spans(text)
        return time.process_time() - began

    took(100)
    assert took(16000) < 40 * max(took(1000), 0.01)


def test_invisible_letters_part_no_word():
    assert cut("It lay in the ru­n. Then it left.") == ["It lay in the ru­n.", "Then it left."]
