import random

import pytest

from seqmill.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
JSON = bpe.DEFAULT_VOCABULARY.replace(".tiktoken", ".json")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_equals_the_tokenizer(reference):
    rng = random.Random(0)
    texts = ["", " ", "a", "aaaa" * 50, "Hello  world\n\n x", "<|endoftext|>", "日本語のテキスト", "ab" * 3000, "don't I'll 123 4.5", "👩‍🔬 é"]
    texts += ["".join(rng.choice("ab c\n.é日1 ") for _ in range(rng.randrange(60))) for _ in range(300)]
    assert bpe.vocabulary(bpe.DEFAULT_VOCABULARY).encode(texts) == reference(texts)


def test_operator(spark, reference):
    rows = [(1, "a b", 0, "x"), (2, None, 1, None), (3, "", 2, None), (4, "word " * 30000, 3, None), (5, "a b", 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, _t string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_texts(df).collect()}
    assert got == {i: reference([t or ""])[0] for i, t, *_ in rows}
    assert bpe.encode_texts(df.limit(0)).count() == 0


def test_vocabulary_is_sent_along(spark, tmp_path, reference):
    import shutil

    mine = str(tmp_path / "mine.tiktoken")
    shutil.copy(bpe.DEFAULT_VOCABULARY, mine)
    out = bpe.encode_texts(spark.createDataFrame([(1, "word by word")], "doc_id long, text string"), path=mine)
    (tmp_path / "mine.tiktoken").unlink()  # no machine has it at the path
    assert list(out.first().ids) == reference(["word by word"])[0]
