"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing names."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqspark.llm import chatfmt, decontam, langid, licenses, mixing, neardup, pii, quality, rules, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and then rests a while under the old oak tree", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog and then rests a while under the old oak tree", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", len(LONG)),
    (5, f"Before. {PASSAGE} after it all", "de", None, 50),
    (None, "a text without an id, ann@mail.example.com", "fr", "b", 5),
    (6, "\n \t\n", "en", "c", 3),
    (7, "é ß 日本語 \x00 ​", None, "c", 9),
    (8, "!!! 123 ...", "en", "c", 11),
    (9, "This work is licensed under the GNU General Public License, version 3.", "en", "c", 70),
]
CLASHES = ("size", "target", "taken", "digest", "row", "rep", "h", "key", "words", "label", "score", "kept", "edits", "n_entities", "at", "band", "component", "n", "held_out")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 0, 0), (4, 1, 0), (6, 0, None), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "under the old oak tree"), (4, "under the old oak tree")], "item_id long, text string")


def operators(docs, labels, benchmark):
    return {
        "languages": lambda: langid.identify(docs, per_language=3),
        "quality": lambda: quality.quality(docs, labels),
        "tokens": lambda: tokencount.count_edited(docs, tokencount.revisions()),
        "near": lambda: neardup.near_duplicates(docs),
        "leaks": lambda: decontam.report(docs, benchmark),
        "rules": lambda: rules.verdicts(docs),
        "pii": lambda: pii.pseudonymised(docs, "k"),
        "mix": lambda: mixing.mix(docs),
    }


@pytest.mark.parametrize("name", ["languages", "quality", "tokens", "near", "leaks", "rules", "pii", "mix"])
def test_a_row_for_each_document(name, docs, labels, benchmark):
    ids = sorted((r["doc_id"] for r in operators(docs, labels, benchmark)[name]().collect()), key=str)
    assert ids == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", ["languages", "quality", "tokens", "near", "leaks", "rules", "pii", "mix"])
def test_empty_tables(name, docs, labels, benchmark):
    none = [x.where("false") for x in (docs, labels, benchmark)]
    assert operators(*none)[name]().collect() == []


def test_defined_results(docs, labels, benchmark):
    lang = {r["doc_id"]: r for r in langid.identify(docs, 3).collect()}
    assert lang[2]["lang_pred"] == lang[3]["lang_pred"] == lang[6]["lang_pred"] == lang[8]["lang_pred"] == "und" and lang[7]["lang_pred"] != "und"
    near = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert near[1]["component_id"] == 1 and near[1]["kept"] and near[None]["kept"] and near[3]["n_shingles"] == 0
    leak = {r["doc_id"]: r for r in decontam.report(docs, benchmark).collect()}
    assert leak[5]["n_hit"] == 12 and leak[1]["n_items"] == 1 and leak[1]["n_hit"] == 5 and leak[2]["n_words"] == 0 and leak[4]["n_hit"] == 0
    mix = {r["doc_id"]: r for r in mixing.mix(docs, block_words=1).collect()}
    assert mix[2]["taken"] == 0 and all(r["taken"] <= 3 * r["size"] for r in mix.values())
    tokens = {r["doc_id"]: r for r in tokencount.count_edited(docs, tokencount.revisions()).collect()}
    assert tokens[2]["n_tokens"] == tokens[3]["n_tokens"] == 0 and tokens[4]["n_recounted"] < 100
    private = {r["doc_id"]: r for r in pii.pseudonymised(docs, "k").collect()}
    assert private[2]["text"] is None and "ann@mail" not in private[None]["text"] and private[4]["text"] == LONG and private[None]["size"] == "x"
    scans = licenses.scan(docs).collect()
    assert [(r["doc_id"], r["license"]) for r in scans] == [(9, "GPL-3.0")]
    assert licenses.scan(docs.where("false")).collect() == [] and licenses.scan(docs, []).collect() == []


def test_near_duplicate_chains_against_all_pairs(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.choices(vocabulary, k=80)) for _ in range(20)]
    rows = []
    for t in texts[:12]:
        words = t.split()
        for _ in range(random.randint(1, 30)):
            words = list(words)
            words[random.randrange(len(words))] = random.choice(vocabulary)
            rows.append(" ".join(words))
    rows += texts
    random.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), shingle=4).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert got == {i: top(i) for i in range(len(rows))}


def test_a_dense_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = [f"t{i}" for i in range(120)]
    rows = [" ".join(f"x{k}" if k <= j < k + 5 else w for j, w in enumerate(base)) for k in range(0, 110)]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), shingle=4)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_one_id_with_two_texts_in_an_open_bucket(spark, monkeypatch):
    """Id 0 has two texts; each is a near copy of others, and chains of copies keep buckets open."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    one, two = [f"a{i}" for i in range(120)], [f"b{i}" for i in range(120)]
    chain = lambda base: [" ".join(f"x{k}" if k <= j < k + 5 else w for j, w in enumerate(base)) for k in range(0, 60, 3)]
    first, second = chain(one), chain(two)
    rows = [(0, first[0]), (0, second[0]), *((10 + i, t) for i, t in enumerate(first[1:])), *((50 + i, t) for i, t in enumerate(second[1:])), (90, "some other text of no relation")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(i, 0 if i < 90 else 90) for i, _ in rows}


def test_sketches_rule_out_no_pair_at_the_threshold():
    """Of pairs just above the threshold, those whose sketches agree in fewer coordinates than is asked: none of many."""
    random = np.random.default_rng(7)
    coordinates = 54 * 6
    least = int(coordinates * (0.8 - 5.2 * (0.8 * 0.2 / coordinates) ** 0.5))
    found = []
    for _ in range(400):
        both, left, right = (random.integers(0, 2**63, k).astype(np.uint64) for k in (160, 20, 20))
        sets = [np.unique(np.concatenate([both, x])) for x in (left, right)]
        low = neardup.circulant_minhash(np.concatenate(sets), np.array([0, len(sets[0])]), coordinates).astype(np.uint8)
        found.append(int((low[0] == low[1]).sum()))
    assert min(found) >= least and abs(np.mean(found) / coordinates - 0.8) < 0.01


def test_spans_of_several_blocks_agree_with_one(spark, docs, benchmark):
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    one = {r["doc_id"]: r for r in decontam.report(unique, benchmark).collect()}
    many = {r["doc_id"]: r for r in decontam.report(unique, benchmark, block_words=3).collect()}
    assert one == many


def test_cleaning_does_not_depend_on_blocks_or_the_order_of_items(spark):
    items = ["a b c d e f g h i j k l", "m n o p q r s t u v w x", "tiny item", "l m n o p q r s t u", "yes y1 y2 y3 y4 y5 y6 y7 y8 y9 y10", "k x k x k x k x k x k x"]
    texts = [
        "Start a b c d e f g h i j, then m n o p q r s t u v and nothing else at all here",  # each 38 %, both more than half
        "one two three a b c d e m n o p q r s t u v f g h i j k l four five six seven eight nine ten eleven twelve thirteen fourteen é " + "more " * 20,  # a cut brings an item together
        "a tiny item in a text of many other words, Tiny, ITEM! again; tiny tiny item item and the rest of it stays as it is",
        "x a b c d e f g h i j k l m n o p q r s t u v w x y and some more words to keep the share low " + "word " * 40,
        "ünïcode a b c d e f g h i j ünïcode l m n o p q r s t u 日本 " + "lang " * 30, "k x " * 8 + "end of it " * 12, None, "", "nothing",
    ]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    results = []
    for order in (items, items[::-1], items[3:] + items[:3]):
        table = spark.createDataFrame(list(enumerate(order)), "item_id long, text string").coalesce(1)
        for words in (decontam.BLOCK_WORDS, 5, 15, 25):
            results.append(sorted(decontam.clean(docs, table, block_words=words).collect(), key=lambda r: r["doc_id"]))
    assert all(r == results[0] for r in results)
    left = {r["doc_id"]: r["text"] for r in results[0]}
    assert 0 not in left and left[6] is None and "a b c d e" not in left[1] and "tiny item" not in left[2].lower() and left[8] == "nothing"


def test_cleaning_leaves_other_text_alone(docs, benchmark):
    out = {r["doc_id"]: r["text"] for r in decontam.clean(docs, benchmark, max_coverage=0.9).collect()}
    assert out[5] == "Before.  after it all" and out[4] == LONG and out[2] is None and out[7] == ROWS[8][1]
    assert 5 not in {r["doc_id"] for r in decontam.clean(docs, benchmark, max_coverage=0.5).collect()}


def test_edits_against_a_new_count():
    pattern, count = tokencount.counter(open(tokencount.VOCABULARY, "rb").read())
    random.seed(5)
    bits = ["a", "b", " ", "  ", "\n", "'s", "'", "9", "é", "!", "\t", "don't", "   q", "."]
    for _ in range(400):
        doc = tokencount.CountedText("".join(random.choices(bits, k=random.randint(0, 40))), pattern, count)
        for _ in range(4):
            doc.edit(random.randint(0, len(doc.text)), random.randint(0, 8), "".join(random.choices(bits, k=random.randint(0, 5))))
            new = tokencount.CountedText(doc.text, pattern, count)
            assert (doc.tokens, doc.n, doc.tree.leaves()) == (new.tokens, new.n, new.tree.leaves()) and doc.tree.root.length == len(doc.text)


def test_an_edit_of_a_long_text_costs_little():
    import time

    pattern, count = tokencount.counter(open(tokencount.VOCABULARY, "rb").read())
    doc = tokencount.CountedText(" ab cd" * 300_000, pattern, count)
    times = []
    for i in range(200):
        t = time.perf_counter()
        doc.edit(9_000 * i, i % 7, " new words" * (i % 3))
        times.append(time.perf_counter() - t)
    assert doc.n > 590_000 and sorted(times)[100] < 0.01
    new = tokencount.CountedText(doc.text, pattern, count)
    assert (doc.tokens, doc.tree.leaves()) == (new.tokens, new.tree.leaves())


def test_a_table_of_edits_against_a_new_count(spark):
    random.seed(8)
    bits = ["a", " ", "\n", "'s", "9", "é", "don't", "word", "."]
    text = lambda n: "".join(random.choices(bits, k=random.randint(0, n)))
    docs = spark.createDataFrame([*((i, text(300)) for i in range(30)), (30, None), (31, ""), (None, "no id"), (3, "again")], "doc_id long, text string")
    edits = [(i, k, random.randint(0, 200), random.randint(0, 20), text(8)) for i in range(0, 34, 2) for k in range(3)] + [(31, 0, 5, 5, "new"), (3, 0, 0, None, None), (None, 0, 0, 9, "x")]
    table = spark.createDataFrame(edits, "doc_id long, seq int, start int, delete int, insert string")
    kept = tokencount.kept_trees(docs)
    out = tokencount.apply_edits(kept, table)
    plain = []
    for r in docs.collect():
        t = r["text"] or ""
        for _, _, start, delete, insert in sorted(e for e in edits if e[0] is not None and e[0] == r["doc_id"]):
            start = min(start, len(t))
            t = t[:start] + (insert or "") + t[start + (delete or 0) :]
        plain.append((r["doc_id"], t))
    new = {(r["doc_id"], r["text"]): r for r in tokencount.kept_trees(spark.createDataFrame(plain, "doc_id long, text string")).collect()}
    got = out.collect()
    assert len(got) == len(plain) and all(tuple(r)[:6] == tuple(new[(r["doc_id"], r["text"])]) for r in got)
    assert all(r["n_recounted"] == 0 for r in got if r["doc_id"] is None or r["doc_id"] % 2 and r["doc_id"] not in (3, 31))


def test_surrogates_keep_types_distinctness_and_mentions(spark):
    texts = [f"card {4000000000000000 + i} mail u{i}@x.example.org ip 10.0.0.{i % 250} and again u{i}@x.example.org" for i in range(300)]
    texts += ["Mrs. Anna Berg met Mr. Berg. Herr Иван Петров wrote token = 'abcdef0123456789abcd'."]
    out = [r["text"] for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    words = [t.split() for t in out[:300]]
    assert len({w[1] for w in words}) == len({w[3] for w in words}) == 300 and len({w[5] for w in words}) == 250
    assert all(w[3] == w[8] and w[3].endswith(".example") and len(w[1]) == 16 for w in words)
    assert not any(f"u{i}@x" in t for i, t in enumerate(out[:300])) and out[300].split()[2] == out[300].split()[5].rstrip(".")
    luhn = lambda s: sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0
    assert [luhn(w[1]) for w in words] == [luhn(str(4000000000000000 + i)) for i in range(300)]


def test_colliding_surrogates_are_drawn_again(spark):
    # two-letter names have few surrogates, so that some collide at first
    rows = [(i, f"Mr. {a}{b}ski went") for i, (a, b) in enumerate(itertools.product("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aeiouylnrst"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.exceptions(docs, "k").where("attempt > 0").count() > 0
    assert pii.pseudonymised(docs, "k").select("text").distinct().count() == len(rows)


def test_chat_tree_shares_and_reads_back(spark):
    rows = [(c, t, r, x) for c in range(4) for t, (r, x) in enumerate([("system", "be <|kind|>"), ("user", "hi"), ("assistant", f"answer {c % 2} </s> <\\|")])]
    rows += [(9, None, None, None), (None, 0, "user", "lost"), (None, 0, "user", "lost")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("shard", F.lit("x"))
    tree = chatfmt.prefix_tree(conversations)
    nodes = tree.nodes.collect()
    assert sum(n["role"] == "system" for n in nodes) == 1 and sum(n["role"] == "assistant" for n in nodes) == 2
    for n in nodes:
        assert n["end"] - n["start"] == len(n["text"]) and sum(a["end"] - a["start"] for a in n["ancestors"]) == n["position"]
    back = {r["conv_id"]: r for r in chatfmt.read_back(tree).collect()}
    assert set(back) == {0, 1, 2, 3, 9, None} and back[0]["loss_chars"] == len("answer 0 </s> <\\|") and back[None]["n_turns"] == 2
    assert chatfmt.read_back(chatfmt.prefix_tree(conversations.where("false"))).collect() == []


def test_a_chat_tree_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(chatfmt, "BLOCK", 16)
    long = "very long " * 20_000
    rows = [(c, t, r, x) for c in range(200) for t, (r, x) in enumerate([("system", "be kind"), ("user", f"hi {c % 40}"), ("assistant", f"answer {c % 90}")][: 1 + c % 3])]
    rows += [(500, 0, "system", "be kind"), (500, 1, "user", long), (501, 0, "system", "be kind"), (501, 1, "user", long)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    was, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 8, 32):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            tree = chatfmt.prefix_tree(conversations.repartition(n), shard_tokens=500)
            seen.append((sorted(tree.nodes.collect(), key=lambda r: r["start"]), sorted(tree.paths.collect(), key=lambda r: r["conv_id"])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1] == seen[2]
    nodes, paths = seen[0]
    assert sum(n["role"] == "system" for n in nodes) == 1 and sum(len(n["text"]) > 100_000 for n in nodes) == 1
    # one stream without gaps, cut into shards, and no beginning twice
    assert nodes[0]["start"] == 0 and all(a["end"] == b["start"] for a, b in zip(nodes[:-1], nodes[1:])) and nodes[-1]["shard"] > 3
    turns = {}
    for c, t, r, x in sorted(rows):
        turns.setdefault(c, []).append((r, x))
    assert len(nodes) == len({tuple(v[: i + 1]) for v in turns.values() for i in range(len(v))}) and len(paths) == len(turns)
    # depth first: a node's descendants follow it before anything else does
    for p in paths:
        assert p["nodes"] == sorted(p["nodes"])


def test_ledger_ablations(docs):
    rows = rules.ledger(docs).persist()
    table = {(r["version"], r["without"]): (r["n_docs"], r["n_kept"]) for r in rules.ablations(rows).collect()}
    assert table[("v1", None)] == (len(ROWS), rules.verdicts(docs).where("kept").count())
    assert table[("base", "few_words")][1] >= table[("base", None)][1]


def test_pipeline_stages(spark, docs, labels, benchmark, tmp_path):
    sf = str(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    benchmark.write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, sf)
        assert out.columns == docs.columns, name
        ids = {r["doc_id"] for r in out.collect()}
        assert ids <= {r[0] for r in ROWS}, name
        current = out
    last = corpus_pipeline.run(spark, sf).collect()
    assert all(0 < r["taken"] <= 3 * r["size"] for r in last)
