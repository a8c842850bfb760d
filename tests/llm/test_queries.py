import pytest

from seqspark.llm.oracles import ORACLES
from seqspark.llm.queries import QUERIES
from tests.compare import DATA, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark):
    assert_same(QUERIES[name], ORACLES[name], spark)


def test_language_held_out(spark):
    rows = QUERIES["op1_language_gru"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [(r["lang"], r["lang_pred"], r["score"]) for r in rows.where("held_out").collect()]
    assert len(held) > 30 and sum(a == b for a, b, _ in held) / len(held) >= 0.95 and all(0 <= s <= 1 for *_, s in held)


def test_quality_held_out(spark):
    rows = QUERIES["op2_quality_fm"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    held = [(r["quality"], r["predicted"]) for r in rows.where("held_out").collect()]
    assert sum(a == b for a, b in held) / len(held) >= 0.9


def test_token_counts_are_those_of_a_whole_encoding(spark):
    import tiktoken

    from seqspark.llm import tokencount as tc

    ranks = tc.counter(open(tc.VOCABULARY, "rb").read())
    rows = QUERIES["op3_token_counts"](spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    import base64

    vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tc.VOCABULARY, "rb").read().splitlines())}
    encode = tiktoken.Encoding("whole", pat_str=tc.PATTERN, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
    assert len(rows) == len(texts) and ranks
    assert all(r["n_tokens"] == len(encode(texts[r["doc_id"]] or "")) for r in rows)
    assert sum(r["n_recounted"] for r in rows) < 0.2 * sum(r["n_pretokens"] for r in rows)
