import zlib

import numpy as np
import pytest

from seqspark.llm import langid, quality


def test_gradients_through_time():
    random = np.random.default_rng(0)
    u, table, bias = random.normal(0, 0.5, (9, 3)), random.normal(0, 0.5, (256, 9)), random.normal(0, 0.5, 3)
    steps = random.integers(0, 5, (6, 4))
    weight = random.normal(0, 1, (6, 3, 4))
    loss = lambda t, w, b: float((langid._gru(t, w, b, steps).astype(np.float64) * weight).sum())
    cache: list = []
    langid._gru(table, u, bias, steps, cache)
    found = langid._gru_back(u, steps, cache, weight)
    for p, g in zip((table, u, bias), found, strict=True):
        for at in [tuple(random.integers(0, 4 if i == 0 else n) if n > 4 else random.integers(0, n) for i, n in enumerate(p.shape)) for _ in range(6)]:
            d = np.zeros_like(p)
            d[at] = 1e-2
            args = [(table, u, bias), (table, u, bias)]
            up, down = ([q + s * d if q is p else q for q in (table, u, bias)] for s in (1, -1))
            assert abs((loss(*up) - loss(*down)) / 2e-2 - g[at]) < 2e-2 * max(1, abs(g[at])), (at, args and 0)


def test_sum_of_squares_identity():
    random = np.random.default_rng(1)
    size = quality.BUCKETS + quality.STATISTICS
    model = quality.FactorisationMachine(0.3, random.normal(0, 1, size), random.normal(0, 1, (size, 4)), np.zeros(10), np.ones(10))
    buckets, values = np.array([3, 7, 9]), np.array([0.5, 0.2, 0.8])
    x = random.normal(0, 1, (1, 10))
    odds = model.parts(buckets, values, np.array([0, 3]), x)[0][0]
    at = np.concatenate([buckets, quality.BUCKETS + np.arange(10)])
    v = np.concatenate([values, x[0]])
    pairs = sum(model.factors[at[i]] @ model.factors[at[j]] * v[i] * v[j] for i in range(13) for j in range(i))
    assert abs(odds - (0.3 + model.weights[at] @ v + pairs)) < 1e-6


def test_fit_without_two_classes():
    assert quality.fit([]).bias == 0
    row = {"buckets": np.int32([1]).tobytes(), "values": np.float32([1]).tobytes(), "statistics": np.zeros(10, np.float32).tobytes(), "label": 1}
    assert quality.fit([row]).bias > 10


def test_the_sample_is_the_same_however_rows_are_stored(spark):
    rows = [(i % 7, f"text {i} of many {i % 3}") for i in range(60)]
    labels = spark.createDataFrame([(i % 7, i % 2) for i in range(14)], "doc_id long, quality int")
    samples = []
    for order in (rows, rows[::-1], sorted(rows)):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(5)
        samples.append(quality.sample(docs, labels, "quality", 6))
    assert len(samples[0]) == 6 and samples[0] == samples[1] == samples[2]


def test_a_rare_label_counts():
    random = np.random.default_rng(2)
    rows = []
    for i in range(240):
        bad = i % 12 == 0
        statistics = random.normal(0, 1, quality.STATISTICS).astype(np.float32)
        statistics[3] += 6 * bad
        buckets = np.sort(random.choice(quality.BUCKETS, 30, replace=False)).astype(np.int32)
        rows.append({"label": int(not bad), "buckets": buckets.tobytes(), "values": np.full(30, 30**-0.5, np.float32).tobytes(), "statistics": statistics.tobytes()})
    model = quality.fit(rows[:180])
    x = np.stack([np.frombuffer(r["statistics"], np.float32) for r in rows[180:]])
    words = np.concatenate([np.frombuffer(r["buckets"], np.int32) for r in rows[180:]])
    scores = model.score(words, np.full(len(words), 30**-0.5, np.float32), np.arange(61) * 30, x)
    good = np.array([r["label"] for r in rows[180:]]) == 1
    assert scores[~good].max() < 0.5 < np.median(scores[good])


def test_languages_of_the_query_against_a_plain_network(spark, monkeypatch):
    """Every byte of the shortest documents, one at a time, with the network that the query has fitted."""
    from seqspark.llm.common import documents
    from tests.compare import DATA

    docs = documents(spark, DATA).where("text IS NOT NULL").orderBy("n_chars", "doc_id").limit(60)
    model = langid.fit(documents(spark, DATA))
    got = {r["doc_id"]: r for r in langid.languages(docs, model).collect()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def run(table, u, bias, data):
        h, out, n = np.zeros(u.shape[1]), [], u.shape[1]
        for byte in data:
            a, b = table[byte], u @ h
            z, r = sigmoid(a[:n] + b[:n]), sigmoid(a[n : 2 * n] + b[n : 2 * n])
            new = np.tanh(a[2 * n :] + r * (b[2 * n :] + bias))
            h = new + z * (h - new)
            out.append(h)
        return out

    for row in docs.collect():
        data, total = row["text"].encode(), np.zeros(len(model.languages))
        strange = [not model.seen[list(c.encode())].all() for c in row["text"] for _ in c.encode()]
        for start in range(0, len(data), langid.STEPS):
            end = min(start + langid.STEPS, len(data))
            low, high = max(0, start - langid.WARM), min(len(data), end + langid.WARM)
            ahead, back = run(*model.params[:3], data[low:high]), run(*model.params[3:6], data[low:high][::-1])[::-1]
            for i in range(start - low, end - low):
                if strange[i + low]:
                    total += 1 / len(total)
                    continue
                odds = model.params[6] @ np.concatenate([ahead[i], back[i]]) + model.params[7]
                total += np.exp(odds - odds.max()) / np.exp(odds - odds.max()).sum()
        lettered = any(c.isalpha() for c in row["text"])
        assert got[row["doc_id"]]["lang_pred"] == (model.languages[int(total.argmax())] if lettered else "und")
        assert not lettered or abs(got[row["doc_id"]]["score"] - total.max() / len(data)) < 1e-4


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(i, f"text {i % 90} of language {i % 90}", f"l{i % 90:02}") for i in range(900)], "doc_id long, text string, lang string")
    names, rows = langid.training_stretches(docs, 300, 20_000, 64)
    assert len(names) == 90 == len({lang for lang, _ in rows})
    assert len(langid.training_stretches(docs, 300, 180, 64)[1]) <= 180
    with pytest.raises(ValueError):
        langid.training_stretches(docs, 300, 50, 64)


def test_repeated_rows_push_no_language_out(spark):
    learned = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(learned, f"one document of many copies {i % 2}", "aa") for i in range(5000)] + [(100 + i, f"autre texte {i}", "bb") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, found = langid.training_stretches(docs, 300, 20_000, 64)
    held = sum(zlib.crc32(str(100 + i).encode()) % 4 == 2 for i in range(40))
    assert names == ["aa", "bb"] and sorted(lang for lang, _ in found) == ["aa"] * 2 + ["bb"] * (40 - held)


def test_unknown_script_says_little(spark):
    rows = [(i, t * 9, lang) for i in range(200) for t, lang in (("the cat and the dog ", "en"), ("der hund und die katze ", "de"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    asked = spark.createDataFrame([(1, "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440"), (2, "the cat and the dog")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.languages(asked, model).collect()}
    assert got[1]["score"] < 0.6 and got[2]["score"] > 0.9
