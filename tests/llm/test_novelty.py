import hashlib
import random
import re
import string

import duckdb
import pytest

from seqspark.llm import novelty
from seqspark.llm.queries import QUERIES
from tests.compare import DATA as SMALLEST

#: The smallest table has no secrets.
DATA = SMALLEST.replace("sf0.001", "sf0.01")

SCHEMA = "doc_id long, text string, spans string, n string"
PROSE = "the handler of the request looks up the account and returns the default value of the session to the client " * 3


def base_sql(kind, pattern, group, least):
    """Spans of one pattern by cutting the text at its matches, without our scanner."""
    return rf"""
    SELECT doc_id, '{kind}' AS kind, start, start + length(m) AS stop FROM (
      SELECT doc_id, m, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS start FROM (
        SELECT r, doc_id, i, ms[i] AS m, gaps[i] AS gap FROM (
          SELECT r, doc_id, ms, string_split_regex(text, $${pattern}$$) AS gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, $${pattern}$$) AS ms FROM documents))))
    WHERE length(regexp_extract(m, $${pattern}$$, {group})) >= {least}"""


def either(word):
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def test_patterns_as_in_sql(spark):
    words = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    parts = [("assign", rf"""(?:{words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24)]
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT doc_id, text FROM read_parquet('{DATA}/documents.parquet')")
    spans = " UNION ALL ".join(f"({base_sql(*p)})" for p in parts)
    found = connection.sql(f"""SELECT doc_id, count(*) FILTER (kind = 'assign'), count(*) FILTER (kind = 'access'), count(*) FILTER (kind = 'hex'),
        sha256(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind = 'hex', kind = 'access')) FROM ({spans}) GROUP BY doc_id""").fetchall()
    want = {r[0]: r[1:] for r in found}
    none = (0, 0, 0, hashlib.sha256(b"").hexdigest())
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in QUERIES["op13_secret_novelty"](spark, DATA).collect()}
    assert want and all(v == want.get(k, none) for k, v in got.items())


@pytest.mark.parametrize(("text", "spans"), [
    ("Password = 'abc123'", "assign:0:18"), ("token=abc", ""), ("é TOKEN:\x20\x20abcdef", "assign:2:16"), ("token='token'=abcdefg", ""), ("api-key: abcdefgh", ""), ("apikey: abcdefgh", "assign:0:16"),
    ("AKIA" + "A" * 16, "access:0:20"), ("AKIA" + "A" * 15, ""), ("xAKIAAKIA" + "B" * 12, "access:1:21"), ("f" * 24 + "g", "hex:0:24"), ("F" * 30, ""), ("ſecret=abcdefgh to\u212aen=abcdefgh", ""),
    ("secret=" + "0a" * 16, "assign:0:39,hex:7:39"), ("", ""), (None, ""),
])
def test_base(spark, text, spans):
    found = sorted(novelty.base_spans(text or ""), key=lambda s: (s[0], s[2]))
    assert novelty._written(found) == spans


def test_novel_strings(spark):
    draw = random.Random(4)
    strange = "".join(draw.choices(string.ascii_letters + string.digits, k=32))
    rows = [(1, f"{PROSE} the secret is {strange} and so on {PROSE}"), (2, f"{PROSE} the secret is the_request_handler_default_value and so on {PROSE}"), (3, f"{PROSE} the shelf is {strange} and so on {PROSE}"),
            (4, f"{PROSE} the secret is {strange}, again {strange}, " + PROSE), (5, None), (6, ""), (None, "bearer " + strange), (7, "token: " + strange), (8, f"password {'xy' * 20}"), (9, f"{'a ' * 200_000} credential {strange}")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in novelty.scan(docs).collect()}
    at = len(PROSE) + len(" the secret is ")
    assert got[1]["spans"] == f"novel:{at}:{at + 32}" and got[1]["n_novel"] == 1 and got[None]["spans"] == "novel:7:39" and got[9]["n_novel"] == 1
    assert got[2]["spans"] == got[3]["spans"] == got[5]["spans"] == got[6]["spans"] == got[8]["spans"] == ""
    assert got[4]["n_novel"] == 2 and got[7]["spans"] == "assign:0:39" and got[7]["n_novel"] == 0
    assert all(r["base_sha256"] == hashlib.sha256(novelty._written(novelty.base_spans(dict(rows)[i] or "")).encode()).hexdigest() for i, r in got.items())
    assert novelty.scan(docs.where("false")).collect() == []


def test_random_strings_add_more_than_words():
    draw = random.Random(8)
    meter = novelty.Meter(PROSE.encode())
    words = re.findall("[a-z]{4,}", PROSE)
    text = " ".join(draw.choices(words, k=150))
    random_rates = sorted(meter.added(text, "".join(draw.choices(string.ascii_letters + string.digits, k=24)), text) / 24 for _ in range(100))
    word_rates = sorted(meter.added(text, w, text) / len(w) for w in ("_".join(draw.choices(words, k=4)) for _ in range(100)))
    assert random_rates[5] >= novelty.NOVELTY > word_rates[-5]
