"""The ten operators against brute force, held-out accuracy and edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.llm import common, decontaminate, disclosure, lattice_lm, license_scan, ngram_join, quality_eb, raking, risk_rules, warc, zstd_lang

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 3000} thing{i % 777}" for i in range(30_000))
#: Columns whose names the operators use inside, to see that they don't meet.
EXTRA = {"n": 1, "id": "x", "uid": 7, "key": "k", "h": None, "p": 0.5, "kept": False, "row": "r", "host": "h", "path": "q", "topic": "t", "spans": "no", "clean_text": "no", "n_email": "no", "component_id": 3, "comp": 4}


def lower(text):
    return text.encode().lower().decode()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return common.table(spark, sf_dir, "labels")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and equal texts, and columns with clashing names."""
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, LONG, "en", None), (4, "One two three", "en", "a"), (5, "one  TWO\nthree", None, None), (6, "one two three", "en", "b"), (6, "one two three", "en", "b"),
        (None, "one two three", "fr", "b"), (None, None, None, None), (7, "\t \n", "en", "a"), (8, "x" * 5000, "fr", "b"), (9, "write to a.b@c.org or +1 (555) 123-4567 now 10.0.0.300 10.0.0.30", "en", "a"), (10, "Ünïcödé 𝒳 é", "fr", "a"),
    ]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({k: F.lit(v).cast("string") if v is None else F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def no_labels(labels):
    return labels.limit(0)


# --- 1 ----------------------------------------------------------------------------------------------------------------


def test_lattice_base_and_order(docs, texts):
    rows = {r.doc_id: r for r in lattice_lm.lattice_scores(docs).collect()}
    tokens = {d: [*lower(t).encode().split(), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
        assert r.score < 0
    mean = lambda c, h: sum(r[c] for r in rows.values() if r.held_out == h) / sum(r.n_tokens for r in rows.values() if r.held_out == h)
    for h in (False, True):
        print("held out" if h else "trained", {c: round(mean(c, h), 3) for c in ("base_score", "score", "vocab_score", "word_score")})
        # training the pieces' weights and words as edges each help by far more than a tenth of a decimal digit a token
        assert mean("score", h) > mean("vocab_score", h) + 1.0 and mean("word_score", h) > mean("score", h) + 0.3
    # on words that the training text has, the discounted word model is as good as the add-one base, which gives away
    # its unknown words at 1 / (N + V + 1) each
    full = [r for r in rows.values() if r.held_out and r.n_known == r.n_tokens]
    assert full and sum(r.word_score for r in full) > sum(r.base_score for r in full) - 0.15 * sum(r.n_tokens for r in full)


def test_lattice_score_is_the_marginal_of_trained_weights(spark):
    """score and vocab_score of whole texts against enumeration, with the weights trained by plain counting."""
    import numpy as np

    df = spark.createDataFrame([(0, "ab ab ba"), (1, "a ba"), (3, "bb")], "doc_id long, text string")
    vocabulary = lattice_lm.vocabulary()
    some = {k: v for k, v in vocabulary.items() if set(k.decode("utf-8", "ignore")) <= set(" ab") and k.isascii()}

    def ways(word):
        return [[word]] * (word in some) + [[word[:i], *rest] for i in range(1, len(word)) if word[:i] in some for rest in ways(word[i:])]

    words = Counter(w for r in df.collect() for w in r.text.split() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2)
    trained_texts = sum(zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in df.collect())
    weights = {k: math.exp(v) for k, v in vocabulary.items()}
    start = dict(weights)
    for _ in range(lattice_lm.WARM + lattice_lm.ROUNDS):
        counts = {k: lattice_lm.PRIOR * v for k, v in start.items()}
        for w, c in words.items():
            each = [(s, float(np.prod([weights[x] for x in s]))) for s in ways(b" " + w.encode())]
            total = sum(p for _, p in each)
            for s, p in each:
                for x in s:
                    counts[x] += c * p / total
        total = sum(counts.values())
        weights = {k: v / total for k, v in counts.items()}
    ends = trained_texts / (sum(words.values()) + trained_texts)
    for r in lattice_lm.lattice_scores(df).join(df, "doc_id").collect():
        for column, w in (("score", weights), ("vocab_score", start)):
            p = [sum(float(np.prod([w[x] for x in s])) for s in ways(b" " + t.encode())) for t in r.text.split()]
            assert r[column] == pytest.approx(sum(map(math.log10, p)) + len(p) * math.log10(1 - ends) + math.log10(ends), abs=1e-6)


def test_lattice_forward_counts_every_segmentation():
    import numpy as np

    pieces = {b" a": 0.2, b" ": 0.1, b"a": 0.2, b"b": 0.2, b"ab": 0.1, b" ab": 0.05, b"ba": 0.15}
    lattice, weights = lattice_lm.Lattice(list(pieces)), np.append(np.log(list(pieces.values())), -np.inf)

    def brute(s):
        return 1.0 if not s else sum(p * brute(s[len(k) :]) for k, p in pieces.items() if s.startswith(k))

    for word in (b"a", b"ab", b"aba", b"abab", b"bbaab"):
        rows = np.frombuffer(b" " + word, np.uint8).reshape(1, -1)
        edges = lattice.edges(rows)
        got = lattice.forward(edges, weights, 1, rows.shape[1])[rows.shape[1]][0]
        assert math.exp(got) == pytest.approx(brute(b" " + word))
        assert lattice.backward(edges, weights, 1, rows.shape[1])[0][0] == pytest.approx(got)


def test_lattice_is_a_distribution_over_words(spark):
    """The scored probabilities of all words of one letter and of longer ones stay below one."""
    df = spark.createDataFrame([(i, w) for i, w in enumerate("abcdefghijklmnopqrstuvwxyz")] + [(100 + i, a + b) for i, (a, b) in enumerate((x, y) for x in "abcdefghij" for y in "abcdefghij")], "doc_id long, text string")
    rows = lattice_lm.lattice_scores(df).collect()
    end = max(r.score for r in rows)
    total = sum(10 ** (r.score) for r in rows)
    assert 0 < total <= 1 and end < 0


def test_lattice_odd(odd, none):
    rows = lattice_lm.lattice_scores(odd).collect()
    assert len(rows) == odd.count()
    assert sorted(r.n_tokens for r in rows)[:4] == [1, 1, 1, 1]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert lattice_lm.lattice_scores(none).count() == 0


# --- 2 ----------------------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    found = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if passes(k, m.group()))
    return [x[2] for x in found]


TRICKY = [
    "a@b.c_d@e.f.g", "x.y%z@q-1.co..uk", "user@host", "@a.b", "a@@b.c", "1.2.3.4.5.6.7.8", "001.02.255.0", "1.2.3.256", "999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "0000 0000 0000",
    "+1 (555) 123-4567 and +49.30.1234567)", "+1", "++12 345 678 901", "é+1 555 555 5555é a@b.de", "4111111111111111 4111111111111111", "1 2 3 4 5 6 7 8 9 0 1 2", "𝒳 a@b.c 𝒳 10.0.0.1",
]


def test_disclosure_base(spark, docs, texts):
    every = texts | {10_000 + i: t for i, t in enumerate(TRICKY)}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    for r in disclosure.sanitised(df).collect():
        want = base(every[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), every[r.doc_id][:80]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PLAIN]
        if not spans:
            assert r.clean_text == every[r.doc_id]


def brute_disclosed(texts):
    """{position: {term: its generalisation or None}} by plain counts over all texts."""
    n, alpha, k = len(texts), disclosure.ALPHA, disclosure.K
    terms = [set(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    entities = []
    for t in texts:
        own = set()
        for kind, p in PLAIN.items():
            for m in re.finditer(p, t):
                if passes(kind, m.group()):
                    own.add((kind, m.group().lower() if kind == "email" else m.group() if kind == "ip" else re.sub("[^0-9]", "", m.group())))
        entities.append(own)
    dt, dc, both = Counter(x for s in terms for x in s), Counter(c for s in entities for c in s), Counter()
    for ts, cs in zip(terms, entities, strict=True):
        both.update((c, t) for c in cs for t in ts)
    out = {}
    for i, (ts, cs) in enumerate(zip(terms, entities, strict=True)):
        for t in ts:
            most = None
            for c in cs:
                p = dc[c] / n
                if p < 1 and math.log2((both[c, t] + k * p) / (dt[t] + k)) - math.log2(p) >= -alpha * math.log2(p):
                    most = max(most or 0.0, (dc[c] + k * p) / p ** (1 - alpha) - k)
            if most is not None:
                safe = [t[:j] for j in range(len(t) - 1, disclosure.BEGIN - 1, -1) if any(x.startswith(t[:j]) and m > most for x, m in dt.items())]
                out.setdefault(i, {})[t] = safe[0] + "*" if safe else None
    return out


def brute_clean(text, found):
    spans = [(int(a), int(b), {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}[k], k) for k, a, b in (x.split(":") for x in base(text))]
    more = [(m.start(), m.end(), found[m.group().lower()] or "", "term") for m in re.finditer(r"[^\W_]+", text) if m.group().lower() in found]
    spans += [x for x in more if not any(s < x[1] and x[0] < e for s, e, _, _ in spans)]
    out, at = [], 0
    for s, e, to, _ in sorted(spans, key=lambda x: (x[0], list(disclosure.KINDS).index(x[3]))):
        if s >= at:
            out.append(text[at:s] + to)
            at = e
    return "".join(out) + text[at:], sum(x[3] == "term" for x in spans)


def test_disclosure_matches_brute_force(spark, texts):
    """Disclosing terms, their generalisations, spans and clean texts over a whole table; terms are there to be found."""
    planted = [f"filler{i} the zanzibar offer of jo@x.org came on day {i} with common words" for i in range(6)] + [f"zanzibariot zanzibariots day {i} common words" for i in range(40)]
    every = [t for t in texts.values() if t.isascii()] + planted
    found = brute_disclosed(every)
    got = {r.doc_id: r for r in disclosure.sanitised(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")).collect()}
    total = 0
    for i, t in enumerate(every):
        clean, n = brute_clean(t, found.get(i, {}))
        total += n
        assert (got[i].clean_text, got[i].n_term, got[i].spans.count("term:")) == (clean, n, n), t[:80]
    assert total > 100 and any(x for f in found.values() for x in f.values()) and any(x is None for f in found.values() for x in f.values())
    first = len(every) - len(planted)
    assert found[first]["zanzibar"] == "zanziba*" and "common" not in found[first] and "zanzibar" not in got[first].clean_text.replace("zanziba*", "")


def test_disclosure_needs_evidence(spark):
    """Ties at the threshold disclose; a common word of all texts and an entity of all texts don't."""
    rows = [(i, f"every text has a@b.org and word{i} in it") for i in range(20)]
    assert all(r.n_term == 0 for r in disclosure.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    one = [(0, "only here: secret7 a@b.org ordinary")] + [(i, "ordinary words") for i in range(1, 3000)]
    got = {r.doc_id: r for r in disclosure.sanitised(spark.createDataFrame(one, "doc_id long, text string")).collect()}
    assert "secret7" not in got[0].clean_text and "ordinary" in got[0].clean_text and all(got[i].n_term == 0 for i in range(1, 3000))


def test_disclosure_odd(odd, none):
    rows = disclosure.sanitised(odd).collect()
    assert len(rows) == odd.count()
    nine = next(r for r in rows if r.doc_id == 9)
    assert (nine.n_email, nine.n_phone, nine.n_ip, nine.n_card) == (1, 1, 1, 0)
    assert nine.clean_text.count("[EMAIL]") == nine.clean_text.count("[PHONE]") == nine.clean_text.count("[IP]") == 1
    assert next(r for r in rows if r.doc_id == 1).clean_text is None
    assert disclosure.sanitised(none).count() == 0


# --- 3 ----------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = lower(text).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    by, parent = defaultdict(list), {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    for a, b in {(min(x, y), max(x, y)) for group in by.values() for x in group for y in group if x != y}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in texts}


def test_join_matches_brute_force(spark, texts):
    import random

    rng, more = random.Random(3), dict(texts)
    for i, t in enumerate([t for t in texts.values() if len(t.split()) > 40][:12]):
        words = t.split()
        for k in range(10):  # near and not quite near copies, in chains
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            more[10_000 + i * 100 + k] = " ".join(words)
    got = ngram_join.jaccard_groups(spark.createDataFrame(list(more.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(more)


def test_join_needs_no_order(spark, monkeypatch, texts):
    """A fixed order of shingles by hash gives the same links as the one by crowd."""
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "FEW", 0)
    monkeypatch.setattr(ngram_join, "GROUP_BITS", 1)
    got = ngram_join.jaccard_groups(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_join_bound_is_no_smaller_than_the_overlap():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m, k in ((3, 5, 2), (50, 60, 40), (700, 500, 450), (5000, 4000, 100)):
        pool = ngram_join._mixed(rng.integers(0, 2**63, n + m - k).astype(np.uint64))
        a, b = pool[:n], pool[n - k :]
        for fine in (True, False):
            assert ngram_join.overlap_bound(ngram_join.point(a, fine), ngram_join.point(b, fine)) >= len(np.intersect1d(a, b)) >= k


def test_join_odd(odd, none):
    rows = ngram_join.jaccard_groups(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[4] == by[5] == [(1, 4)] and by[6] == [(1, 4)] * 2
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[7] == [(0, 7)]
    assert sorted(by[None], key=repr) == sorted([(1, 4), (0, None)], key=repr)
    assert ngram_join.jaccard_groups(none).count() == 0


# --- 4 ----------------------------------------------------------------------------------------------------------------


def test_quality_accuracy(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    rows = quality_eb.quality(docs, train).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) > 0.95 * len(rows)
    assert sum(r.kept for r in rows if r.quality == 1) > 0.97 * sum(r.quality == 1 for r in rows)


def test_quality_sites_shrink(spark):
    rows = [("big", "x", 0.1)] * 200 + [("big", "y", 0.1)] * 200 + [("tiny", "x", 0.1)] + [("good", "x", 0.9)] * 400 + [(None, None, 0.5)] * 3
    got = {(r.host, r.path): r for r in quality_eb.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    m = got["big", "x"].global_p
    assert abs(got["big", "x"].path_p - 0.1) < 0.03 and got["tiny", "x"].path_p > 0.2 and got["tiny", "x"].path_p < m and (None, None) in got


def brute_quality(rows, labels):
    """{doc_id: (doc_p, host_p, path_p, p)} with loops for the sums and a gradient's zero for the fit."""
    import numpy as np

    x = {d: np.array(quality_eb.features(t)) for d, _, _, t in rows}
    train = [d for d in x if d in labels]
    mean, scale = np.mean([x[d] for d in train], 0), np.maximum(np.std([x[d] for d in train], 0), 1e-6)
    z = np.array([[*(x[d] - mean) / scale, 1.0] for d in train])
    y, w = np.array([labels[d] for d in train], float), np.zeros(len(mean) + 1)
    ridge = np.array([1.0] * len(mean) + [1e-6])
    for _ in range(200):  # Newton's steps, with the Hessian by outer products
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve(sum(a * (1 - a) * np.outer(r, r) for a, r in zip(p, z, strict=True)) + np.diag(ridge), z.T @ (y - p) - ridge * w)
    p = 1 / (1 + np.exp(-z @ w))
    assert np.abs(z.T @ (y - p) - ridge * w).max() < 1e-6
    doc = {d: float(1 / (1 + np.exp(-(np.array([*(x[d] - mean) / scale, 1.0]) @ w)))) for d in x}

    hosts, paths = defaultdict(list), defaultdict(list)
    for d, h, q, _ in rows:
        hosts[h].append(doc[d]), paths[h, q].append(doc[d])
    n, m = len(rows), sum(doc.values()) / len(rows)

    def prior(groups, spread):
        if groups < 2:
            return 1e6
        between = max(spread / n - m * (1 - m) * (groups - 1) / n, 1e-9)
        return min(max(m * (1 - m) / between - 1, 1.0), 1e6)

    a = prior(len(hosts), sum(len(v) * (np.mean(v) - m) ** 2 for v in hosts.values()))
    host_p = {h: (a * m + sum(v)) / (a + len(v)) for h, v in hosts.items()}
    b = prior(len(paths) - len(hosts) + 1, sum(len(v) * (np.mean(v) - host_p[h]) ** 2 for (h, _), v in paths.items()))
    path_p = {k: (b * host_p[k[0]] + sum(v)) / (b + len(v)) for k, v in paths.items()}
    odds = lambda q: math.log(min(max(q, 1e-6), 1 - 1e-6) / (1 - min(max(q, 1e-6), 1 - 1e-6)))
    return {d: (doc[d], host_p[h], path_p[h, q], 1 / (1 + math.exp(-(odds(doc[d]) + odds(path_p[h, q]) - odds(m))))) for d, h, q, _ in rows}


def test_quality_matches_brute_force(docs, labels):
    """Whole results on a whole table."""
    rows = [(r.doc_id, r.source, r.lang, r.text or "") for r in docs.collect()]
    want = brute_quality(rows, {r.doc_id: r.quality for r in labels.collect()})
    for r in quality_eb.quality(docs, labels).collect():
        assert (r.doc_p, r.host_p, r.path_p, r.p) == pytest.approx(want[r.doc_id], abs=1e-6)
        assert r.kept == (r.p >= quality_eb.KEEP)


def test_quality_ties_and_repeats(spark):
    """A probability of exactly one half stays; repeated rows count each time; a label given twice counts as the lower."""
    df = spark.createDataFrame([(1, "a b", "en", "s"), (1, "a b", "en", "s"), (2, "c d", "en", "s")], "doc_id long, text string, lang string, source string")
    rows = quality_eb.quality(df, spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int")).collect()
    assert len(rows) == 3 and all(r.p == 0.5 and r.kept for r in rows)


def test_quality_odd(odd, none, labels, no_labels):
    assert quality_eb.quality(odd, labels).count() == odd.count()
    rows = quality_eb.quality(odd, no_labels).collect()
    assert all(r.doc_p == 0.5 for r in rows)
    assert quality_eb.quality(none, labels).count() == 0


# --- 5 ----------------------------------------------------------------------------------------------------------------


def test_raking_meets_margins(spark):
    rows = [("a", "en", "p", 900), ("a", "de", "p", 100), ("b", "en", "q", 300), ("b", "de", "p", 50), ("b", "en", "p", 10), ("a", "en", "q", 5), ("a", "de", "q", 7), ("b", "de", "q", 9)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    want = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.4, "de": 0.6}, "topic": {"p": 0.7, "q": 0.3}}
    got = raking.raked(cells, want).collect()
    for m, shares in want.items():
        for value, share in shares.items():
            assert sum(r.w for r in got if r[m] == value) == pytest.approx(share, abs=1e-3)


def brute_mixture(rows, share):
    """{cell: (weight, p)} by loops: raking in the order of the margins, then one scale by bisection."""
    cells = Counter()
    for source, lang, topic, tokens in rows:
        cells[source, lang, topic] += tokens
    total, to = sum(cells.values()), []
    for i, m in enumerate(raking.MARGINS):
        sums = Counter()
        for k, t in cells.items():
            sums[k[i]] += t
        raw = {v: t ** raking.POWER[m] if t else 0.0 for v, t in sums.items()}
        to.append({v: x / sum(raw.values()) for v, x in raw.items()})
    w = {k: float(t) for k, t in cells.items()}
    for _ in range(400):
        for i in range(3):
            own = Counter()
            for k, x in w.items():
                own[k[i]] += x
            w = {k: x * to[i][k[i]] / own[k[i]] if own[k[i]] > 0 else 0.0 for k, x in w.items()}
    w = {k: x / sum(w.values()) for k, x in w.items()}
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(t, mid * w[k]) for k, t in cells.items()) < share * total else (low, mid)
    return {k: (w[k] * total / t if t else 0.0, (0.0 if w[k] <= 0 else 1.0) if not t else min(1.0, high * w[k] / t)) for k, t in cells.items()}


@pytest.mark.parametrize("few", [True, False])
def test_raking_matches_brute_force(docs, monkeypatch, few):
    """Weights and probabilities of a whole table, by windows and by joins."""
    monkeypatch.setattr(raking, "WINDOW_CELLS", 10**6 if few else 0)
    rows = raking.mixture(docs).collect()
    want = brute_mixture([(r.source, r.lang, r.topic, r.n_tokens) for r in rows], raking.SHARE)
    for r in rows:
        weight, p = want[r.source, r.lang, r.topic]
        assert r.error < raking.TOLERANCE and r.weight == pytest.approx(weight, rel=0.02, abs=1e-3) and r.p == pytest.approx(p, rel=0.02, abs=1e-3)


def test_raking_says_how_far_impossible_targets_are(spark):
    """Two cells can't meet these margins: the fit ends and says so; ties and repeated rows share one fate."""
    docs = spark.createDataFrame([(i, "x y z " * 20, "en" if i % 2 else "de", "a" if i % 2 else "b") for i in range(40)] + [(1, "x y z " * 20, "en", "a")], "doc_id long, text string, lang string, source string")
    rows = raking.mixture(docs, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.2, "de": 0.8}}).collect()
    assert len(rows) == 41 and all(r.error > 0.1 for r in rows) and len({r.kept for r in rows if r.doc_id == 1}) == 1


def test_raking_sample(docs, odd, none):
    rows = raking.mixture(docs, share=0.4).collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.p for r in rows) == pytest.approx(0.4 * tokens, rel=0.02)
    assert {r.n_tokens for r in rows} == {len(WORD.findall(t or "")) for t in [r.text for r in docs.collect()]}
    assert all(r.kept for r in rows if r.p >= 1) and not any(r.kept for r in rows if r.p <= 0)
    assert raking.mixture(odd).count() == odd.count() and raking.mixture(none).count() == 0


# --- 6 ----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    more = spark.createDataFrame([(9001, "http://A.example/x y", "WARC/1.1\r\n\r\nsame " * 200), (9003, None, "WARC/1.1\r\n\r\nsame " * 200), (9002, "http://a.example/x#z", "WARC/1.1\r\n\r\nsame " * 200), (9004, "u", None), (9005, "u", "small"), (9006, "u", "small"), (None, "n", "é" * 600), (9007, "n", "é" * 600)], pages.schema)
    every = pages.unionByName(more)
    text = {r.page_id: r.html or "" for r in every.collect()}
    groups = defaultdict(list)
    for i, t in text.items():
        if len(t.encode()) >= 1000 and i is not None:
            groups[t].append(i)
    got = warc.archived(every).collect()
    assert len(got) == every.count()
    for r in got:
        raw = text[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        top = max(groups.get(text[r.page_id], [r.page_id]), key=lambda x: -1 if x is None else x)
        if r.page_id is not None:
            assert (r.record_type, r.refers_to) == (("response", None) if top == r.page_id else ("revisit", top))
    order = [(r.urlkey, r.captured) for r in sorted(got, key=lambda r: (r.part, r.place))]
    assert order == sorted(order)
    assert warc.archived(every.limit(0)).count() == 0


def test_warc_clashing_columns_and_repeated_rows(spark, sf_dir):
    """Extra columns named like the operator's own, and rows that share an id, with equal and other payloads."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    big, other = "same " * 300, "other " * 300
    rows = spark.createDataFrame([(7001, "http://b.example/", big), (7001, "http://b.example/", big), (7000, "http://b.example/", big), (7001, "http://b.example/", other)], pages.schema)
    clash = ("rank", "part", "place", "uri", "payload", "key", "k", "keeper", "bytes", "sha1", "value", "run", "captured", "n", "offset")
    got = warc.archived(pages.unionByName(rows).withColumns({c: F.lit(c) for c in clash})).where("page_id >= 7000").collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got if r.page_id == 7000) == [(7000, 1500, "revisit", 7001)]
    assert sorted((r.payload_bytes, r.record_type) for r in got if r.page_id == 7001) == [(1500, "response"), (1500, "response"), (1800, "response")]


def test_merge_holds_one_block_a_run(spark, tmp_path, monkeypatch):
    """Many archives and ranges: the rank is the global order, and a merge never holds more than a block of each run."""
    import random

    rng = random.Random(8)
    monkeypatch.setattr(warc, "FILE_RECORDS", 90)
    pages = [(i, f"http://h{rng.randrange(40)}.example/p{rng.randrange(30)}" if i % 3 else "http://hot.example/", f"page {i}") for i in range(3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = sorted(warc.archived(df, range_rows=200).collect(), key=lambda r: r.rank)
    assert [r.rank for r in got] == list(range(3000)) and len({r.part for r in got}) >= 12
    assert [(r.urlkey, r.captured, r.page_id) for r in got] == sorted((warc.url_key(u), f"2020-01-01T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z", i) for i, u, _ in pages)

    runs = {f"r{k}": sorted((f"r{k}", f"u{rng.randrange(500):03d}", "t", rng.randrange(10**6), None, 0, "", "", None, i) for i in range(700)) for k in range(7)}
    stream = []
    for name, rows in runs.items():
        rows = sorted(rows, key=warc._order)
        cut = rows[rng.randrange(100) :]  # a range begins in the middle of a block
        stream += [(warc._order(rows[rows.index(r) // warc.BLOCK * warc.BLOCK - 1]) if rows.index(r) >= warc.BLOCK else (), r) for r in cut]
        runs[name] = cut
    low = max(min(map(warc._order, c)) for c in runs.values())
    stream = [(b, r) for b, r in stream if warc._order(r) >= low]
    stream.sort(key=lambda x: (x[0] and (1, *x[0]) or (0,), x[1][0], warc._order(x[1])))
    blocks = warc.Blocks(iter([(*r, *(b or (None,) * 6)) for b, r in stream]))
    merged = list(warc.LoserTree(blocks.runs(), warc._order))
    assert merged == sorted((r for _, r in stream), key=warc._order) and blocks.most <= len(runs) * warc.BLOCK < len(merged) / 5


def test_loser_tree():
    import random

    rng = random.Random(5)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


# --- 7 ----------------------------------------------------------------------------------------------------------------


def distance(a, b):
    """Least edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_decontamination_recall_and_distance(spark):
    import random

    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(20, 60)))) for i in range(20)] + [(90, "Tiny Item"), (91, None), (92, "")]
    docs, leaks = [], {}
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(50, 400))]
        if d % 2:
            i, item = items[d % 20]
            edited = list(item)
            for _ in range(int(len(item) * 0.08)):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = rng.choice([[], [rng.choice(letters)], [edited[at], rng.choice(letters)]])
            text[len(text) // 2 : len(text) // 2] = ["".join(edited).upper() if d % 3 else "".join(edited).replace(" ", "\n ")]
            leaks[d] = i
        docs.append((d, " ".join(text)))
    docs += [(500, "a tiny  item here"), (501, "tiny items"), (502, None), (None, "tiny item")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id): r.distance for r in got}
    assert {p for p in pairs if p[1] < 90} == set(leaks.items())
    assert {p for p in pairs if p[1] >= 90} == {(500, 90), (None, 90)}
    for (d, i), x in list(pairs.items())[:6]:
        if i < 90:
            assert x == distance(decontaminate.normal(items[i][1]).decode(), decontaminate.normal(docs[d][1]).decode())


def test_decontamination_without_spaces():
    """Exact and edited passages in the middle of Chinese, Thai and unspaced Latin text."""
    import random

    rng = random.Random(4)
    for letters in ([chr(c) for c in range(0x4E00, 0x5200)], [chr(c) for c in range(0xE01, 0xE2F)], list("abcdefghijklmnopqrstuvwxyz0123456789")):
        prose = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: E731, B023
        items = [(i, prose(rng.randrange(80, 200))) for i in range(12)]
        docs, leaks = [], set()
        for d in range(48):
            i, item = items[d % 12]
            chars = list(item)
            for _ in range(int(len(item) * 0.08) if d >= 24 else 0):
                at = rng.randrange(len(chars))
                chars[at : at + 1] = rng.choice([[], [rng.choice(letters)], [chars[at], rng.choice(letters)]])
            docs.append((prose(300) + "".join(chars) + prose(300)).encode() if d % 2 else prose(900).encode())
            leaks |= {(d, i)} if d % 2 else set()
        found = decontaminate.Items(items).find(docs)
        assert {(d, items[k][0]) for d, k, _ in found} == leaks


def test_decontamination_of_short_items():
    """Items of 20 to 190 bytes at 10 and 15 % edits, and whole ones in quotes and brackets: all are found."""
    import random

    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(60)[:n].strip()) for i, n in enumerate(x for x in (20, 25, 30, 45, 60, 75, 90, 120, 150, 190) for _ in range(6))]
    items += [(100, "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed"), (101, "q7 answer")]
    docs, leaks = [], set()
    for d in range(240):
        i, item = items[d % 60]
        edited = list(item)
        for _ in range(int(len(item) * (0.10 if d < 120 else 0.15))):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice([[], [rng.choice(letters)], [edited[at], rng.choice(letters)]])
        docs.append(f"{prose(60)} ({''.join(edited)}) {prose(60)}".encode())
        leaks.add((d, i))
    docs += ["\u6211\u8bf4\u4eca\u5929\u5929\u6c14\u5f88\u574f\u6211\u4eec\u53bb\u516c\u56ed\u5427".encode(), b'the "q7 answer" is', b"the q7 answers are"]
    leaks |= {(240, 100), (241, 101)}
    block = decontaminate.Items(items)
    got = {(d, items[k][0]) for d, k, _ in block.find(docs)}
    assert leaks <= got and (242, 101) not in got
    assert all(block.distance(k, docs[d].decode()) <= block.most[k] for d, k, _ in block.find(docs))


def test_decontamination_groups_hold_the_pieces_needed():
    """Every group has so many pieces near each other; every place that has them is a group."""
    import random

    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    block = decontaminate.Items([(i, prose(60)[:n].strip()) for i, n in enumerate([60, 90, 120, 180] * 6)])
    docs = [prose(300).encode() for _ in range(40)] + [f"{prose(50)} {block.text[k]} {prose(50)}".encode() for k in range(24)] + [b"", b"abc"]
    want, got = set(), set()
    for part in block.pieces:
        got |= set(part.groups(docs))
        for d, text in enumerate(docs):
            for k in sorted(set(part.owner.tolist())):
                hits = [(at - o, o) for o, p in decontaminate.pieces(block.text[k], part.size) for at in range(len(text)) if text.startswith(p, at)]
                for p in {p for p, _ in hits}:
                    if len({o for q, o in hits if p <= q <= p + part.band[k]}) >= part.need[k]:
                        want.add((d, k, p))
    assert got == want and {(40 + k) for k in block.cut} <= {d for d, _, _ in got}


def test_decontamination_tables(spark, docs, sf_dir, odd, none):
    benchmark = common.table(spark, sf_dir, "benchmark")
    text = {r.item_id: decontaminate.normal(r.text).decode() for r in benchmark.collect()}
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in text.items() if t in decontaminate.normal(r.text or "").decode()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert exact <= got and len(got) <= len(exact) + 2
    assert decontaminate.contaminated(odd, benchmark).count() == 0 and decontaminate.contaminated(none, benchmark).count() == 0 and decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


# --- 8 ----------------------------------------------------------------------------------------------------------------


def test_language_accuracy(spark, odd, none):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = zstd_lang.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) > 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    got = zstd_lang.languages(odd).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if r.doc_id in (1, 2, 7)} == {"und"} and {r.lang_pred for r in got} <= {"en", "fr", "und"}
    assert zstd_lang.languages(none).count() == 0


def test_language_matches_brute_force(spark, docs):
    """Every prediction from plain compression of the whole text, piece by piece, with each dictionary."""
    import zstandard

    books = zstd_lang.learned(docs, "doc_id", "text", "lang", 3, 1)
    assert list(books)[0] == "en" and all(len(b) <= zstd_lang.DICTIONARY for b in books.values())
    how = zstandard.ZstdCompressionParameters.from_level(zstd_lang.LEVEL, source_size=zstd_lang.PIECE, dict_size=zstd_lang.DICTIONARY, write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in zstd_lang.languages(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        raw = zstd_lang.plain(r.text or "")
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert r.lang_pred == "und"
            continue
        size = {}
        for lang, book in books.items():
            d = zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            size[lang] = sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(raw[i : i + zstd_lang.PIECE])) for i in range(0, len(raw), zstd_lang.PIECE))
        best, second = sorted(size.values())[:2]
        assert r.lang_pred == min(size, key=lambda x: (size[x], list(size).index(x))) and r.rejected == (second - best < zstd_lang.MARGIN * second)


def test_languages_beyond_one_block_and_ties(spark, docs, monkeypatch):
    """Dictionaries in blocks of two give the same as in one; equal languages tie, and the name decides."""
    want = {(r.doc_id, r.lang_pred, r.score, r.rejected) for r in zstd_lang.languages(docs).collect()}
    monkeypatch.setattr(zstd_lang, "BLOCK", 2)
    assert {(r.doc_id, r.lang_pred, r.score, r.rejected) for r in zstd_lang.languages(docs).collect()} == want
    same = spark.createDataFrame([(i, "the same text for both", lang) for i, lang in ((0, "zz"), (2, "aa"), (3, "zz"), (5, "aa"), (6, "zz"), (9, "aa")) for _ in range(2)], "doc_id long, text string, lang string")
    got = zstd_lang.languages(same).collect()
    assert len({r.lang_pred for r in got}) == 1 and all(r.rejected for r in got)


# --- 9 ----------------------------------------------------------------------------------------------------------------


def brute_rules(t):
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)


def test_rules_base(docs, labels, texts, odd, none):
    for r in risk_rules.quality_rules(docs, labels).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(texts[r.doc_id])
    rows = risk_rules.quality_rules(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 7, None))
    assert risk_rules.quality_rules(none, labels).count() == 0


def test_rules_bound_is_exact():
    for k, n, level in ((0, 100, 0.05), (3, 200, 0.01), (10, 1000, 0.001)):
        p = risk_rules.upper_bound(k, n, level)
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(level, rel=1e-6)
    assert risk_rules.upper_bound(5, 5, 0.1) == 1.0


def brute_factor(severities, strata, risk=risk_rules.RISK, delta=risk_rules.DELTA):
    """The same search with the bound by bisection on exact sums."""
    n, best = len(severities), None
    for f in risk_rules.GRID:
        k = sum(x > f for x in severities)
        # the bound is at most risk if so few or fewer failures are improbable enough at risk itself
        if k >= n or sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) > delta / strata:
            break
        best = f
    return best


def brute_severity(t):
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    n, chars, symbols, dup, repeat, _ = brute_rules(t)
    upper = sum("A" <= c <= "Z" for c in t)
    share = lambda a, b: min(1.0, a / max(b, 1))
    parts = {"symbols": share(symbols, chars), "dup_lines": share(dup, len(lines)), "repeats": share(repeat, n), "upper": share(upper, chars)}
    return {k: v / risk_rules.REFERENCE[k] for k, v in parts.items()}


def test_rules_fire_and_keep_the_promise(spark):
    """Whole verdicts against brute force, and the loss among good texts that the rules never saw."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    labels = common.table(spark, "/root/testdata/sf0.01", "labels")
    rows = {r.doc_id: (r.lang or "", r.text or "") for r in docs.collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    seen = {d for d, q in label.items() if q == 1 and d in rows and d % 2 == 0}
    severity = {d: brute_severity(t) for d, (_, t) in rows.items()}
    strata = {rows[d][0] for d in seen}
    want = {s: brute_factor([max(severity[d].values()) for d in seen if rows[d][0] == s], len(strata)) for s in strata}
    got = risk_rules.quality_rules(docs, labels.where("doc_id % 2 = 0")).collect()
    for r in got:
        lang = rows[r.doc_id][0]
        f = want.get(lang)
        assert r.factor == f
        assert r.failed == ",".join(k for k, v in severity[r.doc_id].items() if f is not None and v > f)
        assert r.kept == (not r.base_failed and not r.failed)
    on = {s for s, f in want.items() if f is not None}
    assert on and sum(bool(r.failed) for r in got) > 0
    assert any(r.failed and not r.base_failed and label.get(r.doc_id) == 0 for r in got)
    for s in on:
        fresh = [r for r in got if rows[r.doc_id][0] == s and label.get(r.doc_id) == 1 and r.doc_id % 2]
        assert sum(bool(r.failed) for r in fresh) <= 2 * risk_rules.RISK * len(fresh)


def test_rules_hold_their_risk_over_many_draws(spark):
    """Of many strata drawn at random, next to none loses more than RISK of its whole population."""
    import random

    rng = random.Random(2)
    rows = [(f"s{s}", rng.expovariate(1.0 / (0.2 + 0.2 * (s % 3)))) for s in range(300) for _ in range(400)]
    got = {r.stratum: r.factor for r in risk_rules.factors(spark.createDataFrame(rows, "stratum string, severity double")).collect()}
    assert all(f is not None for f in got.values())
    assert not [s for s, f in got.items() if math.exp(-f / (0.2 + 0.2 * (int(s[1:]) % 3))) > risk_rules.RISK]


def test_rules_odd(spark, labels):
    """Too few labels, no labels, ties at a cutoff, one id in two strata and twice in one."""
    few = spark.createDataFrame([(i, "en", "word " * 60) for i in range(50)], "doc_id long, lang string, text string")
    good = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    assert {r.factor for r in risk_rules.quality_rules(few, good).collect()} == {None}
    assert {r.factor for r in risk_rules.quality_rules(few, labels.limit(0)).collect()} == {None}
    n = 400
    assert risk_rules.factor(n, [0] * len(risk_rules.GRID), 0.0125) == risk_rules.GRID[-1]
    assert risk_rules.factor(n, [n] * len(risk_rules.GRID), 0.0125) is None
    prose = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(200)]
    rows = [(i, "en", t) for i, t in enumerate(prose)] + [(0, "en", prose[0]), (0, "de", "# " * 60), (500, "en", prose[1].replace("w", "#"))]
    got = risk_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(r.failed == "" and r.factor == risk_rules.GRID[-1] for r in got if r.doc_id not in (0, 500))
    assert [r.failed for r in got if r.doc_id == 500] == ["symbols"]


# --- 10 ---------------------------------------------------------------------------------------------------------------

FAMILIES = {"CC BY-NC": "CC-BY-NC", "GNU General Public License, version 3": "GPL-3.0", "Apache License": "Apache-2.0", "MIT License": "MIT"}


def test_licenses(spark, docs, texts):
    more = [(10_000, "Some prose.\nReleased under the MIT License.\nMore prose"), (10_001, "She got a driving license and permission to go.\nAll rights reserved."), (10_002, "SPDX-License-Identifier: Apache-2.0\nThis work is licensed under the GNU General Public License, version 3."), (10_003, None), (None, "Released under the MIT License.")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r for r in license_scan.licenses(df).collect()}
    for d, t in texts.items():
        assert got[d].families == ",".join(sorted(v for k, v in FAMILIES.items() if k in t)), t[:80]
    assert [got[i].families for i in (10_000, 10_001, 10_002, 10_003, None)] == ["MIT", "", "Apache-2.0,GPL-3.0", "", "MIT"]


#: Notices in other words or of other versions than the templates', and notices of licences that no family has.
VARIANTS = {
    "Released under the GPL v2.": "GPL-2.0", "Released under the GPL v3.": "GPL-3.0", "Licensed under the GNU General Public License v2.0": "GPL-2.0", "Licensed under Apache 2.0": "Apache-2.0",
    "Licensed under the Mozilla Public License 2.0": "MPL-2.0", "This work is licensed under CC BY 4.0": "CC-BY",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS': "MIT",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.": "",
    "Distributed under the Boost Software License, Version 1.0.": "", "Licensed under the zlib license.": "", "ISC License": "", "She works at MIT and holds a license.": "",
}


def brute_grams(p):
    w = re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", p.lower())
    return {*w, *map(" ".join, zip(w, w[1:], strict=False))}


def brute_license(p, model, least):
    """Family of a paragraph by plain sums over all weights, covers of all notices and versions."""
    families = list(license_scan.NOTICES)
    g = brute_grams(p)
    if not g & set(model.weights):
        return 0.0, ""
    z = [b + sum(model.weights[x][i] for x in g if x in model.weights) for i, b in enumerate(model.bias)]
    e = [math.exp(x - max(z)) for x in z]
    known = 1 - e[-1] / sum(e)
    having = Counter(x for ps in license_scan.NOTICES.values() for x in {y for q in ps for y in brute_grams(q)})
    most = math.log(len(families) + 1)
    weight = lambda x: most - math.log(having[x]) if x in having else most
    named = lambda q: {m[1] for w in re.sub(r"[^\w.]+", " ", q.lower()).split() if (m := re.fullmatch(license_scan.VERSION.strip("^$"), w.rstrip("."))) and len(m[1]) == 1}
    best = []
    for i, f in enumerate(families):
        allowed = {v for q in license_scan.NOTICES[f] for v in named(q)}
        cover = max(sum(map(weight, g & h)) / min(sum(map(weight, h)), sum(map(weight, g))) for h in map(brute_grams, license_scan.NOTICES[f]))
        if cover >= license_scan.COVER and (not allowed or named(p) <= allowed):
            best.append((-e[i], f))
    return known, (min(best)[1] if best and known > least else "")


def test_licenses_match_brute_force(spark, texts):
    """Every paragraph of the table, scored without any search for words first, and the calibration's promise."""
    df = spark.createDataFrame([*texts.items(), *((10_000 + i, t) for i, t in enumerate(VARIANTS))], "doc_id long, text string")
    s = license_scan.scan(df, "doc_id", "text")
    kinds = {}
    every = {p for t in [*texts.values(), *VARIANTS] for p in t.split("\n")}
    for p in every:
        known, kinds[p] = brute_license(p, s["model"], s["least"])
        assert any(w in p.lower() for w in s["needed"]) or known < license_scan.LEAST, p
    for r in license_scan.licenses(df).collect():
        t = texts.get(r.doc_id) or dict(enumerate(VARIANTS)).get(r.doc_id - 10_000, "")
        found = [kinds[p] for p in t.split("\n") if kinds[p]]
        assert (r.n_notices, r.families) == (len(found), ",".join(sorted(set(found)))), t[:80]
    for t, family in VARIANTS.items():
        assert kinds[t] == family, t
    rows = s["calibration"].collect()
    assert len(rows) > 16 and sum(r.known > s["least"] for r in rows) <= license_scan.FALSE_SHARE * len(rows) + 1e-9


def test_licenses_ties(spark):
    """Of two families with one probability the first by name; of versions that no family has, none."""
    rows = spark.createDataFrame([("a", ["under"], [], 0.9, [1 / 13] * 13)], "pid string, g array<string>, vs array<string>, known double, ps array<double>")
    sentence = license_scan.NOTICES["GPL-2.0"][2]
    own = rows.withColumn("g", license_scan.grams(F.lit(sentence)))
    paragraphs, guesses = own.select("pid", "g", license_scan.versions(F.lit(sentence)).alias("vs")), own.select("pid", "known", "ps")
    assert [r.family for r in license_scan.confirmed(spark, paragraphs, guesses).collect()] == ["GPL-2.0"]
    foreign = paragraphs.withColumn("vs", F.array(F.lit("7")))
    assert license_scan.confirmed(spark, foreign, guesses).count() == 0


def test_licenses_odd(odd, none):
    assert license_scan.licenses(odd).count() == odd.count()
    assert license_scan.licenses(none).count() == 0


# --- shared -----------------------------------------------------------------------------------------------------------


def test_components(spark):
    links = [(i + 1, i) for i in range(1, 60)] + [(200, 100), (100, 300), (7, 7)]
    got = {r.id: r.comp for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
