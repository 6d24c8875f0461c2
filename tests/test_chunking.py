import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semdex.config import Chunking
from semdex.functions import tokenizer
from semdex.operators import chunking
from semdex.sources import code


def parts(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).head()[0]


def chunks(spark, text, path="/a.txt", **config):
    rows = chunking.chunked(spark.createDataFrame([(path, text)], "file_path string, text string"), Chunking(**config)).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    return [(r["content"], r["token_count"]) for r in rows]


def test_splits(spark):
    assert parts(spark, chunking.split_prose, "a\nb\n\n c \r\n\r\n\n\n") == ["a\nb", "c"]
    assert parts(spark, chunking.split_prose, " \n\n ") == []
    assert parts(spark, chunking.split_code, " ") == [" "]
    assert parts(spark, chunking.split_markdown, "# A\ntext\n## B\nmore\n\nend\n#include") == ["# A\ntext", "## B\nmore", "end", "#include"]


def test_blank_texts_have_no_chunks(spark):
    for blank in ("", "  \n\t\u00a0", None):
        assert chunks(spark, blank) == []


def test_packing(spark):
    # 3 + 3 tokens fit 6; the join's two tokens show in the count only.
    assert chunks(spark, "a b c\n\nd e f\n\ng", max_chunk_tokens=6, overlap_tokens=0) == [("a b c\n\nd e f", 8), ("g", 1)]
    assert chunks(spark, "a\n\nb c d e f g h\n\ni", max_chunk_tokens=4, overlap_tokens=1) == [("a", 1), ("b c d e", 4), ("e f g h", 4), ("i", 1)]


def test_long_run_of_words(spark):
    found = chunks(spark, "word " * 200, max_chunk_tokens=100, overlap_tokens=20)
    assert len(found) > 1 and all(n <= 100 for _, n in found)


@settings(max_examples=20, deadline=None)
@given(n=st.integers(1, 60), size=st.integers(2, 20), overlap=st.integers(0, 19))
def test_windows_cover_all_tokens(spark, n, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            chunking.windows(F.lit(None), size, overlap)
        return
    toks = [str(k) for k in range(n)]
    got = spark.createDataFrame([(toks,)], "t array<string>").select(chunking.windows(F.col("t"), size, overlap)).head()[0]
    assert all(len(w) <= size for w in got) and got[-1][-1] == toks[-1]
    joined = got[0] + [x for w in got[1:] for x in w[overlap:]]
    assert joined == toks


def test_no_python_in_the_plan(spark, sf):
    df = chunking.chunked(spark.createDataFrame([("/a.md", "x")], "file_path string, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LINES = st.lists(st.sampled_from(["", "a b", "c", "d e f g h", "  ", "# t", "i j k l m n o p q"]), max_size=8)


@settings(max_examples=6, deadline=None)
@given(LINES)
def test_lists_pack_as_columns_do(spark, lines):
    text = "\n\n".join(lines)
    want = chunks(spark, text, max_chunk_tokens=4, overlap_tokens=1)
    segments = parts(spark, chunking.split_prose, text)
    assert [(p["content"], p["n"]) for p in chunking.packed_list(segments, tokenizer.tokenizer(""), 4, 1)] == want


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_tokens_of_a_vocabulary(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(VOCABULARY)
    count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    long = " ".join(f"antidisestablishmentarianism{k} 😀é 漢字" for k in range(40))
    text = f"First  words.\n\nSecond <|endoftext|> part.\n\n{long}\n\nLast."
    config = {"max_chunk_tokens": 50, "overlap_tokens": 0, "tokenizer": VOCABULARY}
    found = chunks(spark, text, **config)
    first, second = "First  words.", "Second <|endoftext|> part."
    assert found[0] == (f"{first}\n\n{second}", count(first) + count(second) + 2) and found[-1] == ("Last.", count("Last."))
    assert "".join(c for c, _ in found[1:-1]) == long and len(found) > 10
    assert all(n == count(c) and n <= 52 for c, n in found[1:-1])
    lapped = [c for c, _ in chunks(spark, text, **config | {"overlap_tokens": 10})[1:-1]]
    assert all(any(b.startswith(a[-k:]) for k in range(5, 60)) for a, b in zip(lapped, lapped[1:]))
    assert chunks(spark, None, **config) == chunks(spark, " \n", path="/a.bin", **config) == []
    code_config = Chunking(max_chunk_tokens=30, overlap_tokens=5, tokenizer=VOCABULARY, rescue_oversized=True)
    items = code.chunks_of("def f():\n    return 1\n\ndef g():\n    return '" + "xyzzy " * 60 + "'\n", "python", code_config)
    assert items[0][1:] == ("fn::f", count(items[0][0])) and len(items) > 2 and all(n == count(c) for c, _, n in items)
