import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
OTHER = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def _ids(texts):
    import numpy as np

    return [np.frombuffer(x, dtype=np.int32).tolist() for x in bpe.encoder(PATH, P.PATTERN).ids(texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'aeé0!　\u0085")), max_size=60), max_size=5))
def test_as_the_other_library(texts):
    assert _ids(texts) == [OTHER.encode_ordinary(t) for t in texts]


def test_odd_spaces():
    odd = ["", " ", "  a  b", "a \n b", "x  y", "　 z z", "don't I'll", "a\x1c b \x1c c", "a  ", " a", "\u0085 a\u0085b", "tab\t a\tb", "x \n", "  ", " b  \n\n c", "\n\n", "a " * 400_000, "x" * 100_000, "\u3000".join("abc") + " d" * 9]
    assert _ids(odd) == [OTHER.encode_ordinary(t) for t in odd]


def test_round_trip_and_edges(spark, edge, none):
    done = bpe.decode(bpe.encode(edge, PATH, P.PATTERN, with_offsets="spots"), PATH, out="size", text_out="again")
    rows = done.collect()
    assert len(rows) == edge.count() and set(done.columns) == set(edge.columns) | {"ids", "spots", "again"}
    for r in rows:
        text = r["text"] or ""
        assert r["ids"] == OTHER.encode_ordinary(text) and bytes(r["size"]) == text.encode() and r["again"] == text
        assert len(r["spots"]) == len(r["ids"])
        covered = set()
        for s in r["spots"]:
            covered |= set(range(s["start"], s["end"]))
        assert covered == set(range(len(text)))
    assert bpe.encode(none, PATH, P.PATTERN).count() == 0


def test_split_and_unknown(spark):
    emoji = OTHER.encode_ordinary("😀")
    rows = spark.createDataFrame([(emoji[:1],), (emoji,), ([10**6],), ([],), (None,)], "ids array<int>")
    got = [(r["decoded"], r["t"]) for r in bpe.decode(rows, PATH, text_out="t").collect()]
    assert got[0][1] == "�" and bytes(got[1][0]) == "😀".encode() and got[2] == (None, None) and bytes(got[3][0]) == b"" and got[4] == (None, None)


def test_query(spark):
    from tidewheel.llm.queries import op10_byte_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op10_byte_bpe(spark, sf).collect():
        ids = OTHER.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
