"""Each method against brute force, an exact round trip or held-out accuracy."""

import itertools
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import htmltext, langid, lmscore, mixing, neardup, outliers, packing, quality, topk, toxicity
from gridloom.llm.common import table, word_hashes

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labelled(spark):
    return table(spark, SF, "labels").toPandas().set_index("doc_id")


def test_quality_held_out(spark, documents, labelled):
    got = quality.op8(spark, documents, table(spark, SF, "labels")).toPandas().set_index("doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got["held_out"].items())
    both = got[got["held_out"]].join(labelled, how="inner")
    assert len(both) > 40 and (both["predicted"] == both["quality"]).mean() > 0.95


def test_compiled_rules_equal_plain_evaluation(spark, documents, labelled):
    """Every document's score, rule by rule in Python over the statistics, against the column expression."""
    from gridloom.llm import stats

    model = quality.train_quality(documents, table(spark, SF, "labels"))
    shape = stats.with_shape(documents).select("doc_id", *stats.SHAPE).toPandas().set_index("doc_id")
    got = quality.score_quality(documents, model, "s").select("doc_id", "s").toPandas().set_index("doc_id")["s"]
    assert len(model.rules) > 5
    for i, x in shape.iterrows():
        z = model.intercept + sum(w for rule, w in model.rules if all((x[f] <= v) if op == "<=" else (x[f] > v) for f, op, v in rule))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_lasso_finds_the_one_rule():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] <= 0.5)).astype(int)
    m = quality.fit_rules(x, y, ["a", "b", "c"])
    z = np.full(len(x), m.intercept)
    for rule, w in m.rules:
        on = np.ones(len(x), bool)
        for f, op, t in rule:
            v = x[:, "abc".index(f)]
            on &= v <= t if op == "<=" else v > t
        z += w * on
    assert ((z > 0) == y).mean() > 0.97 and len(m.rules) < 120


def brute_marginals(model, em):
    n, total, one = len(em), 0.0, np.zeros(len(em))
    for s in itertools.product((0, 1), repeat=n):
        z = (model.start if s[0] else 0.0) + sum((model.bias + e) * v for e, v in zip(em, s, strict=True)) + sum(model.trans[a][b] for a, b in itertools.pairwise(s))
        p = np.exp(z)
        total += p
        one += p * np.array(s)
    return one / total


@pytest.mark.parametrize("seed", range(6))
def test_gap_collapsed_marginals_equal_enumeration(seed):
    r = np.random.default_rng(seed)
    m = toxicity.Field(float(r.normal(-1, 1)), float(r.normal()), ((0.0, float(r.normal())), (float(r.normal()), float(r.normal()))))
    em = np.where(r.random(10) < 0.4, r.normal(0, 3, 10), 0.0)
    em[seed] = 1.0
    at = np.flatnonzero(em).tolist()
    assert np.allclose(m.marginals(10, at, em[at].tolist()), brute_marginals(m, em)[at])


def test_toxicity_held_out(spark, documents, labelled):
    got = toxicity.op1(spark, documents, table(spark, SF, "labels")).toPandas().set_index("doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got["held_out"].items())
    both = got[got["held_out"]].join(labelled, how="inner")
    assert both.loc[both["toxic"] == 0, "predicted"].mean() < 0.01 and both.loc[both["toxic"] == 1, "predicted"].mean() > 0.7


def test_toxicity_of_every_document_equals_a_plain_forward_backward(spark, documents):
    """All texts of 300 tokens or less by the dense recursion over every token, then the score from its definition."""
    m = toxicity.train_toxicity(documents, table(spark, SF, "labels"))
    got = toxicity.tag_toxicity(documents.select("doc_id", "text"), m).toPandas()
    a = np.exp(np.array(m.trans))
    some = 0
    for text, out in zip(got["text"], got["toxicity"], strict=True):
        words = toxicity.TOKEN.findall(text or "")
        if not 0 < len(words) <= 300:
            continue
        some += 1
        e = np.array([sum(m.weights.get(f, 0.0) for f in toxicity.features(w)) for w in words])
        step = np.stack([np.ones(len(e)), np.exp(m.bias + e)], 1)
        f, b = np.empty((len(e), 2)), np.ones((len(e), 2))
        f[0] = step[0] * [1, np.exp(m.start)]
        for i in range(1, len(e)):
            f[i] = (f[i - 1] / f[i - 1].sum()) @ a * step[i]
        for i in range(len(e) - 2, -1, -1):
            b[i] = a @ (step[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        p = (f * b)[:, 1] / (f * b).sum(1)
        seen = -np.log1p(-np.minimum(p[e != 0], 1 - 1e-12)).sum()
        c, k, n = m.curve
        assert abs(out["score"] - 1 / (1 + np.exp(-(c + k * np.log1p(seen) + n * np.log1p(len(e)))))) < 1e-6
        ends = [x.end() for x, q in zip(toxicity.TOKEN.finditer(text), (p >= 0.5) & (e != 0), strict=True) if q]
        assert [s["stop"] for s in out["spans"]] == ends
    assert some > 200


def test_a_stem_that_clean_texts_hold_once_counts_where_it_is_frequent():
    r = np.random.default_rng(1)
    word = lambda stem="": stem + "".join(r.choice(list("abcdefghijklmnop"), 6))
    texts = [" ".join([word() for _ in range(60)] + [word("rude") for _ in range(8 if i < 30 else i % 10 == 0)]) for i in range(400)]
    m = toxicity.fit_field(texts, [1] * 30 + [0] * 370)
    tag = toxicity.Tagger(m).tag
    fresh = [" ".join([word() for _ in range(60)] + [word("rude") for _ in range(k)]) for k in (0, 1, 8)]
    assert [tag(t)[0] >= 0.7 for t in fresh] == [False, False, True] and m.curve[2] <= 0


def test_a_cue_of_few_documents_survives_one_clean_document():
    r = np.random.default_rng(0)
    texts = [" ".join("".join(r.choice(list("abcdefghijklmnop"), 10)) for _ in range(12)) for _ in range(220)]
    y = [1] * 12 + [0] * 208
    texts = [f"{t} zzyzzx" if i < 13 else t for i, t in enumerate(texts)]
    assert "=zzyzzx" in toxicity.cues(toxicity.Corpus(texts), y)


@pytest.mark.parametrize("seed", range(4))
def test_threshold_search_equals_sorting(seed):
    r = np.random.default_rng(seed)
    c, q = r.integers(-5 - 40 * seed, 40, (300, 6)).astype(float), r.integers(-40, 40, (7, 6)).astype(float)
    q[0] = 0
    ids = np.arange(300) * 3
    for x, own, (got, score) in zip(q, ids[:7], topk.threshold_search(q, c, ids, ids[:7], 10), strict=True):
        s = c @ x
        want = sorted((i for i in range(300) if ids[i] != own), key=lambda i: (-s[i], ids[i]))[:10]
        assert got.tolist() == ids[want].tolist() and score.tolist() == s[want].tolist()


def test_the_bound_saves_work_on_vectors_with_structure():
    r = np.random.default_rng(5)
    c = np.where(r.random((4_000, 40)) < 0.05, r.integers(1, 1_000, (4_000, 40)), 0).astype(float)
    q, ids, scored = c[:20], np.arange(4_000), []
    got = topk.threshold_search(q, c, ids, ids[:20], 10, scored=scored)
    for x, i, (best, score) in zip(q, ids[:20], got, strict=True):
        want = sorted((j for j in range(4_000) if j != i), key=lambda j: (-(c[j] @ x), j))[:10]
        assert best.tolist() == want and score.tolist() == (c[want] @ x).tolist()
    bars = np.array([s[-1] for _, s in got])
    more: list = []
    again = topk.threshold_search(q, c, ids, ids[:20], 10, bars, more)
    assert np.mean(scored) < 0.5 * 4_000 and sum(more) <= sum(scored)
    assert all((a[0] == b[0]).all() for a, b in zip(got, again, strict=True))


def topk_oracle(duck_rows):
    import duckdb
    import pandas as pd

    from gridloom.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    embeddings = pd.DataFrame(duck_rows, columns=["vec_id", "embedding"])  # noqa: F841
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", duck_rows)
    return sorted(con.execute(ORACLE_SQL["op2_threshold_topk"]).fetchall())


def test_repeated_and_large_vectors_score_as_in_sql(spark):
    rows = [(0, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 9.0]), (100, [1e8, 3.0]), (7, [1e8, -2.0]), (8, [1e30, 1.0]), (9, [-1e30, 1e30]), (200, [1e30, -1e30]), (11, [3e4, 3e4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op2(spark, df).collect())
    assert got == topk_oracle(rows) and max(r[3] for r in got) == (1 << 63) - 1


def test_blocks_do_not_change_the_result(spark):
    v = topk.quantise(table(spark, SF, "embeddings"))
    a, b = (topk.search(v, F.col("vec_id") % 50 == 0, 10, *size).orderBy("query_id", "rank").toPandas() for size in ((16384, 4096), (70, 3)))
    assert a.equals(b) and len(a) == 100


def test_base_rules_against_python(spark, documents):
    import re

    got = outliers.op3(spark, documents).toPandas().set_index("doc_id")
    for r in documents.select("doc_id", "text").collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        on = set()
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                on |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(on))
        assert tuple(got.loc[r["doc_id"], outliers.BASE]) == want
        assert got.loc[r["doc_id"], "base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_outliers_keep_good_texts(spark, documents, labelled):
    both = outliers.op3(spark, documents).toPandas().set_index("doc_id").join(labelled, how="inner")
    rest = both[~both["base_failed"]]
    assert rest.loc[rest["quality"] == 1, "kept"].mean() > 0.98 and rest.loc[rest["quality"] == 0, "kept"].mean() < 0.05


def test_estimates_equal_an_exact_search(spark):
    """Concentration on sorted distances from 60 random starts, against the binned steps from three."""
    r = np.random.default_rng(11)
    n = 700
    z = r.normal(size=(n, 5)) @ np.diag([0.8, 0.1, 0.5, 0.4, 0.9]) + np.array([5, 1.7, 0.5, 0.5, 1.0])
    z[: n // 9] += np.array([0, 0.5, 5, 3, 4])
    floors = np.diag(np.square(outliers.FLOORS))
    dist = lambda m, s: np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(s), z - m)
    of = lambda x: (x.mean(0), np.cov(x.T, bias=True) + floors)
    h, best = -(-n * 3 // 4), (np.inf, None)
    for _ in range(60):
        m, s = of(z[r.choice(n, 12, replace=False)])
        for _ in range(40):
            m, s = of(z[np.argsort(dist(m, s))[:h]])
        best = min(best, (np.linalg.slogdet(s)[1], (m, s)), key=lambda x: x[0])
    d = dist(*best[1])
    scale = max(1.0, np.sort(d)[h - 1] / outliers.chi2_quantile(0.75))
    want = dist(*of(z[d <= scale * outliers.chi2_quantile(0.975)]))
    rows = [(i, "x", "y", False, *map(float, v)) for i, v in enumerate(z)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, base_failed boolean, z0 double, z1 double, z2 double, z3 double, z4 double")
    groups = outliers.assign(stats, 60)
    model = outliers.fit(stats, groups, 1, 0.75).first()
    low = np.zeros((5, 5))
    for (i, j), v in zip(outliers.PAIRS, model["low"], strict=True):
        low[i, j] = v
    got = dist(np.array(model["m"]), low @ low.T)
    at = outliers.chi2_quantile(1 - outliers.ALPHA)
    assert ((got > at) == (want > at)).all() and (want > at)[: n // 9].all() and np.median(abs(got / want - 1)) < 0.03


def test_distance_equals_numpy(spark):
    r = np.random.default_rng(0)
    z = r.normal(size=(200, 5)) @ r.normal(size=(5, 5))
    df = spark.createDataFrame([(1, *map(float, x)) for x in z], "g int, z0 double, z1 double, z2 double, z3 double, z4 double")
    sums = df.groupBy("g").agg(F.count("*").alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(5)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in outliers.PAIRS])
    got = df.join(outliers.estimate(sums, ["g"]), "g").select(outliers.distance()).toPandas().iloc[:, 0].sort_values().to_numpy()
    c = np.cov(z.T, bias=True) + np.diag(np.square(outliers.FLOORS))
    d = z - z.mean(0)
    assert np.allclose(got, np.sort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)))


def test_every_start_is_stepped_until_it_settles(spark, documents, monkeypatch):
    """No start leaves the steps while another one would lower its determinant; small and large groups alike."""
    steps, real = [], outliers.estimate

    def watched(sums, keys):
        out = real(sums, keys)
        if keys == ["g", "start"]:
            steps.append({(r["g"], r["start"]): r["logdet"] for r in out.collect()})
        return out

    monkeypatch.setattr(outliers, "estimate", watched)
    outliers.robust_outliers(documents).count()
    assert len(steps) > 2
    for k, now in enumerate(steps[1:], 1):
        went_on = {g for g, v in steps[k - 1].items() if k == 1 or steps[k - 2][g] - v > outliers.FALL}
        assert set(now) == went_on
    assert all(steps[-2][g] - v <= outliers.FALL for g, v in steps[-1].items())



def plain_losses(docs, members):
    """n_tokens, loss_target and loss_background of every document, from dictionaries of words and of pairs of words."""
    words = [re.findall("[a-z0-9\x80-\U0010ffff]+", (x or "").lower()) for _, x in docs]
    member = [i in members for i, _ in docs]
    sizes = [sum(len(w) for w, on in zip(words, member, strict=True) if on), sum(map(len, words))]
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for w, on in zip(words, member, strict=True):
        for m in (0, 1) if on else (0,):
            one[m].update(["<"] * bool(w) + w)
            two[m].update(zip(["<"] + w, w, strict=False))
    vocabulary = max(1, len(set(one[0]) - {"<"}))
    for w, on in zip(words, member, strict=True):
        out, own1, own2 = [], Counter(["<"] + w), Counter(zip(["<"] + w, w, strict=False))
        for m in (1, 0):
            own = on or not m
            scale = 1.0 if m or not sizes[0] else min(sizes[0] / sizes[1], 1.0)
            total = (sizes[0] if m else sizes[1]) - own * len(w)
            loss = []
            for v, x in zip(["<"] + w, w, strict=False):
                c = (one[m][v] - own * own1[v]) * scale
                b = min((two[m][v, x] - own * own2[v, x]) * scale, c)
                lam = 0.7 * c / (c + 1)
                loss.append(-np.log(lam * b / max(c, 1e-12) + (1 - lam) * ((one[m][x] - own * own1[x]) * scale + 0.5) / (total * scale + 0.5 * vocabulary)))
            out.append(np.mean(loss) if w else None)
        yield len(w), *out


@pytest.mark.parametrize("small", [False, True])
def test_losses_of_every_document_by_dictionaries(spark, documents, monkeypatch, small):
    """With one range and one chunk a task, and with many of both."""
    if small:
        monkeypatch.setattr(lmscore, "CHUNK", 50_000)
        monkeypatch.setattr(lmscore, "RANGE", 40_000)
    docs = documents.unionByName(documents.limit(3).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long")}))
    target = documents.where("doc_id % 3 = 0").select("doc_id").distinct()
    got = lmscore.score(docs.repartition(5), target).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((str(i), *x) for (i, _), x in zip(rows, plain_losses(rows, {r[0] for r in target.collect()}), strict=True)), key=str)
    have = sorted(((str(r["doc_id"]), r["n_tokens"], r["loss_target"], r["loss_background"]) for r in got), key=str)
    assert len(have) == len(want)
    for x, y in zip(have, want, strict=True):
        assert x[:2] == y[:2] and (x[2:] == y[2:] == (None, None) or np.allclose(x[2:], y[2:], atol=1e-9)), (x, y)


def test_a_bigram_of_one_document_counts_as_unseen(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "green red violet"), (3, "red green blue")], "doc_id long, text string")
    once = {r["doc_id"]: r["loss_background"] for r in lmscore.score(docs, docs.where("doc_id = 9").select("doc_id")).collect()}
    assert once[1] == once[3] < once[2]
    alone = {r["doc_id"]: r["loss_background"] for r in lmscore.score(docs.where("doc_id < 3"), docs.where("doc_id = 9").select("doc_id")).collect()}
    rows = [tuple(r) for r in docs.where("doc_id < 3").collect()]
    assert np.allclose([alone[1], alone[2]], [x[2] for x in plain_losses(rows, set())])


def test_loss_difference_tells_quality(spark, documents, labelled):
    got = lmscore.op4(spark, documents, table(spark, SF, "labels")).toPandas().set_index("doc_id").join(labelled, how="inner")
    assert got.loc[got["quality"] == 0, "ce_diff"].median() > got.loc[got["quality"] == 1, "ce_diff"].median()


def check_packing(rows, got, capacity, tok):
    by_doc = dict(list(got.sort_values("start").groupby("doc_id")))
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        p = by_doc[i]
        assert p["start"].tolist() == np.cumsum([0, *p["length"][:-1]]).tolist() and p["length"].sum() == len(ids) == p["doc_tokens"].iloc[0]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(p["start"], p["length"], strict=True)] == p["ids_crc32"].tolist()
    sizes = []
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == np.cumsum([0, *s["length"][:-1]]).tolist() and s["length"].sum() <= capacity
        sizes.append(s["length"].sum())
    return sizes


@pytest.mark.parametrize("capacity", [2048, 100])
def test_packing_round_trip(spark, documents, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = packing.pack(documents, packing.tokenizer_path(), capacity).toPandas()
    sizes = check_packing(rows, got, capacity, tok)
    assert 1 - sum(sizes) / len(sizes) / capacity < (0.01 if capacity == 2048 else 0.04)


def test_packing_fills_bins_by_class_over_workers(spark, documents, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP", 3)  # three levels
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = packing.pack(documents.repartition(11), packing.tokenizer_path()).toPandas()
    sizes = check_packing(rows, got, 2048, Tokenizer.from_file(packing.tokenizer_path()))
    assert 1 - sum(sizes) / len(sizes) / 2048 < 0.02 and set(got["sequence_id"] // 2**60) <= {0, 1, 2, 3}
    for (level, _), s in got.assign(level=got["sequence_id"] // 2**60).groupby(["level", "sequence_id"]):
        j = 2048 // s["length"]
        if level < got["sequence_id"].max() // 2**60:
            assert j.nunique() == 1 and len(s) == j.iloc[0]  # a bin has the fixed number of its class


def test_token_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    r = np.random.default_rng(3)
    al = [*"abstdmrevl'' \n\t\x0b09.,!?<|>Àßéÿ×÷", "'s", "'ll", " I'm "]
    more = [*al, "<|endoftext|>", "<|StartOfText|>", "<|startoftext|>", "中文", "e\u0301", "\u00a0", "İ", "Σ", "’s", "\x1c", "½"]
    for letters in (al, more):
        texts = ["".join(letters[i] for i in r.integers(0, len(letters), n)) for n in r.integers(0, 40, 2_000)]
        ids, begin, end = enc.encode(pa.array([*texts, None]))
        for t, a, b in zip([*texts, ""], begin, end, strict=True):
            assert ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids
    assert 49407 in tok.encode("a <|endoftext|>", add_special_tokens=False).ids


def test_long_runs_are_not_remembered():
    enc = packing.Encoder(packing.tokenizer_path())
    r = np.random.default_rng(4)
    for k in range(30):
        texts = ["".join(chr(c) for c in r.integers(0x4E00, 0x9FA5, 20_000)), "".join(chr(c) for c in r.integers(97, 123, 20_000)), f"word{k}"]
        enc.encode(pa.array(texts))
    for m in (enc.parts, enc.words):
        m.most = 10
        m.shrink()
        assert all(len(p) <= packing.KEPT for p in m.number) and len(m.flat) <= 40


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    rules = json.loads(Tokenizer.from_file(packing.tokenizer_path()).to_str())
    rules["normalizer"]["normalizers"].pop()
    (tmp_path / "t.json").write_text(json.dumps(rules))
    tok, enc = Tokenizer.from_file(str(tmp_path / "t.json")), packing.Encoder(str(tmp_path / "t.json"))
    ids, begin, end = enc.encode(pa.array(["Ab c", "IT'S"]))
    assert [ids[a:b].tolist() for a, b in zip(begin, end, strict=True)] == [tok.encode(t).ids for t in ("Ab c", "IT'S")]


def test_piece_lengths():
    for n in range(1, 5_000):
        got = packing.cut_lengths(n, 2048)
        assert sum(got) == n and min(got) > 0 and max(got) <= 2048
        assert all((2048 - 2048 // k * k) / 2048 < 0.04 for k in got)


@pytest.mark.parametrize("parts", [[1], [3, 5], [512, 1, 1, 510], [7, 11, 13, 1, 992], list(range(1, 30))])
def test_frames_deviate_by_less_than_a_block(parts):
    frame, got, total = mixing.edf_frame(parts), Counter(), sum(parts)
    for t, s in enumerate(frame, 1):
        got[s] += 1
        assert all(abs(Fraction(t * a, total) - got[k]) < 1 for k, a in enumerate(parts))
    assert [got[k] for k in range(len(parts))] == parts


def test_phases_schedule_every_block_once():
    blocks, parts = [40, 3, 0, 17], [600, 100, 24, 300]
    slots = defaultdict(list)
    for s, first, past, slot0, a, frame, places, _ in mixing.phases(blocks, parts):
        for b in range(first, past):
            k = b - first
            slots[s].append(slot0 + k // a * frame + places[k % a])
    assert sorted(x for v in slots.values() for x in v) == list(range(60)) and [len(slots[s]) for s in range(4)] == blocks
    assert all(v == sorted(v) for v in slots.values())


def test_any_number_of_sources(spark, monkeypatch):
    rows = [(i, None if i % 1500 == 0 else f"s{i % 1500}") for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs, block=2).select("doc_id", "source", "mix.*").toPandas()
    assert sorted(got["doc_id"]) == list(range(4_000)) and got["position"].is_unique
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    again = mixing.mix(docs, block=2).select("doc_id", "source", "mix.*").toPandas()
    order = lambda p: p.sort_values("doc_id").values.tolist()
    assert order(got) == order(again)


def test_mixture_follows_the_weights(spark, documents):
    got = mixing.mix(documents, {f"src{i}": float(i + 1) for i in range(20)}, block=1).select("source", "mix.*").toPandas().sort_values("position")
    assert got["position"].tolist() == list(range(len(got)))
    first = got[got["phase"] == 0]
    goal = np.array(mixing.whole_parts([float(got_i + 1) for got_i in (int(s[3:]) for s in sorted(got["source"].unique()))], 1024))
    seen = first["source"].value_counts().reindex(sorted(got["source"].unique())).fillna(0).to_numpy()
    assert (abs(seen - goal / goal.sum() * len(first)) < 1).all()
    small = mixing.mix(documents, {f"src{i}": float(i + 1) for i in range(20)}, block=1, per_bucket=37).select("mix.*").toPandas()
    assert sorted(small["position"]) == got["position"].tolist()


@pytest.mark.parametrize("weights", [{f"s{i:02}": float(i + 1) for i in range(20)}, None])
def test_mixture_deviates_by_less_than_a_block_from_the_true_weights(spark, weights):
    n = [500] * 20 if weights else [6000, *range(300, 319)]
    docs = spark.createDataFrame([(i * 10_000 + k, f"s{i:02}") for i, x in enumerate(n) for k in range(x)], "doc_id long, source string")
    got = mixing.mix(docs, weights, block=1).select("source", "mix.*").where("phase = 0").orderBy("slot").toPandas()
    true = [Fraction(weights[f"s{i:02}"] if weights else x**0.5) for i, x in enumerate(n)]
    true = np.array([float(x / sum(true)) for x in true])
    assert got["slot"].tolist() == list(range(len(got))) and len(got) > 2048
    seen = np.cumsum(np.eye(20)[got["source"].str[1:].astype(int)], axis=0)
    assert (abs(seen - np.arange(1, len(got) + 1)[:, None] * true) < 1 + 1e-6).all()


def brute_classes(rows):
    ids, texts = [r["doc_id"] for r in rows], [r["text"] for r in rows]
    cell, own = neardup.cells(pa.array(texts))
    sets, root = [set(cell[own == i].tolist()) for i in range(len(ids))], list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inv, both = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for c in s:
            inv[c].append(i)
    for v in inv.values():
        both.update(itertools.combinations(v, 2))
    for (a, b), n in both.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= neardup.SIMILAR:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_near_duplicates_equal_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    assert {r["doc_id"]: r["class_id"] for r in neardup.op7(spark, documents).collect()} == brute_classes(rows)


def test_near_duplicates_equal_sql(spark):
    """Nulls, empties, texts without words or of one to four, repeated rows and ids, case, marks, chains and repeated shingles."""
    import duckdb

    from gridloom.llm.queries import ORACLE_SQL

    base = [f"word{i}" for i in range(60)]
    texts = [None, None, "", "", "!!", "??", "a b", "A, b", "b a", "a b c d", "a b c d e", "x " * 40, "x " * 44, "x " * 80, " ".join(base), " ".join(base).upper()]
    texts += [" ".join(base[: 60 - k]) for k in range(2, 30, 4)] + [" ".join([*base[:k], "é", *base[k:]]) for k in (0, 7, 60)]
    rows = [(i + 1, x) for i, x in enumerate(texts)] + [(3, ""), (15, "a b c d e"), (None, "a b"), (100, None), (100, "a b")]
    got = neardup.op7(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(tuple(r) for r in got) == sorted(con.execute(ORACLE_SQL["op7_dart_minhash"]).fetchall())


def test_chains_and_large_groups(spark, monkeypatch):
    """Copies that drift apart: neighbours are similar, the ends are not; blocks smaller than the group."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(500)]
    base = r.choice(vocab, 200).tolist()
    rows, text = [], list(base)
    for i in range(60):
        rows.append((i, " ".join(text)))
        text[(i * 7) % 200] = vocab[r.integers(500)]
        text[(i * 31 + 3) % 200] = vocab[r.integers(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in neardup.op7(spark, df).collect()} == brute_classes(df.orderBy("doc_id").collect())


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    est, true = [], []
    for k in range(150):
        a = r.choice(1 << 40, 60, replace=False).astype(np.uint64)
        n = r.integers(10, 55)
        b = np.concatenate([a[:n], r.choice(1 << 40, 60 - n, replace=False).astype(np.uint64)])
        wa, wb = r.random(60) * 0.9 + 0.1, r.random(60) * 0.9 + 0.1
        wb[: n // 2] = wa[: n // 2]
        s = neardup.darts(np.concatenate([a, b]), np.repeat([0, 1], 60), 2, np.concatenate([wa, wb]))
        est.append((s[0] == s[1]).mean())
        low, high = np.minimum(wa[:n], wb[:n]).sum(), np.maximum(wa[:n], wb[:n]).sum()
        true.append(low / (high + wa[n:].sum() + wb[n:].sum()))
    err = np.array(est) - np.array(true)
    assert abs(err.mean()) < 0.012 and err.std() < 0.06


def test_word_hashes_depend_on_words_alone():
    h, row = word_hashes(pa.array(["One two", None, "", "two  ÉTÉ été, one"]))
    assert row.tolist() == [0, 0, 3, 3, 3, 3] and h[0] == h[5] and h[1] == h[2] and h[3] == h[4] and len(set(h.tolist())) == 3
    sliced, _ = word_hashes(pa.array(["x", "One two"]).slice(1))
    assert sliced.tolist() == h[:2].tolist()


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav>%s<footer>f</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>A</h1><p>one<p>two &lt; three<br>four</p></article>", "A one two < three four"),
        ("<main><header>h</header><p>x</p><aside>s</aside><form><p>q</p></form><p>y</p><div class='comments'><p>c</p></div></main>", "x y"),
        ("<div class='cookie-notice'>We use cookies</div><div id=content><p>" + "long text here. " * 9 + "</p><p>Short.</p></div><div><a>l1</a><a>l2</a><a>l3</a></div>", "long text here. " * 9 + "Short."),
        ("<article><p>a<script>var x='</p>';</script>b</p><noscript>n</noscript></article>", "ab"),
        ("<article><p>caf&eacute;&nbsp;&#8212; x\n\t y</p>", "café — x y f"[:-2]),
        ("", ""),
    ],
)
def test_main_text(body, want):
    assert htmltext.main_text(PAGE % body) == want


LONG = "A sentence of the article that goes on for a while. " * 4


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<article><p>{LONG}</p><p>{LONG}</p><div>%s</div><p>{LONG}</p></article>", LONG * 3),
        (f"<main><div><p>{LONG}</p><p>{LONG}</p></div><div>%s</div></main>", LONG * 2),
        (f"<article><section><p>Short.</p></section><section><p>{LONG}</p></section></article><div><p>{LONG}</p></div>", "Short. " + LONG),
        (f"<div><p>{LONG}</p></div><article><p>Short.</p></article>", LONG + "Short."),  # the mark is not where the text is
        (f"<article><div class='social-science'><p>{LONG}</p></div><div class='related work'><p>{LONG}</p></div></article>", LONG * 2),
        (f"<article><p>{LONG}</p><div class='related'>%s</div><div class='share-box'>%s</div></article>", LONG),
        (f"<article><p>{LONG}</p><article class='comment'><p>{LONG}</p></article><div id='comment-list'><p>{LONG}</p></div></article>", LONG),
        (f"<ul role=main><li>{LONG}<li><math><mi>x</mi></math> is known.</ul><div><a>one</a><a>two</a></div>", LONG + "x is known."),
        (f"<article><div><a>one</a></div><div><p>{LONG}</p><p>{LONG}</p></div></article>", LONG * 2),
    ],
)
def test_ratios_decide_inside_marked_articles(body, want):
    links = "<ul>" + "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(12)) + "</ul>"
    assert htmltext.main_text(PAGE % body.replace("%s", links)) == want.strip()


def plain_article(page):
    import html

    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_ratios_decide_on_the_pages(spark, monkeypatch):
    """Without names and marks nearly all pages give the same text; without the ratios none does."""
    pages = [r["html"] for r in table(spark, SF, "pages").collect()]
    bare = [re.sub(r"<(/?)(nav|footer)\b", r"<\1div", re.sub(r"</?article>", "", p)).replace(' class="ad"', "") for p in pages]
    assert sum(htmltext.main_text(b) == plain_article(p) for b, p in zip(bare, pages, strict=True)) >= 0.9 * len(pages)
    monkeypatch.setattr(htmltext, "on_content", lambda lines: [True] * len(lines))
    unmarked = [re.sub(r"</?article>", "", p) for p in pages]
    assert sum(htmltext.main_text(u) != plain_article(p) for u, p in zip(unmarked, pages, strict=True)) >= 0.5 * len(pages)


@pytest.mark.parametrize("marked", [True, False])
def test_article_text_of_the_pages(spark, marked):
    """The method finds the same text whether or not a page marks its article."""
    import html
    import re

    pages = table(spark, SF, "pages")
    shown = pages if marked else pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    rows = htmltext.op9(spark, shown).join(pages.select("page_id", "html"), "page_id").collect()
    right = 0
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        right += r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split()) and r["n_chars"] == len(r["text"])
    assert len(rows) == pages.count() and right == len(rows)


def test_broken_pages_are_read_in_linear_time():
    import time

    r = np.random.default_rng(2)
    bits = ["<", ">", "<!", "<![", "<![foo[ a ]]>", "<![CDATA[x]]>", "<!--", "-->", "</", "<p", "<b>", "</b>", "<div class='related'>", "<td>", "</table>", "&amp", "&#x;", "text ", "<a href=", "'", '"', "<?x", "<li>", "<script>", "</script>"]
    for _ in range(3_000):
        assert isinstance(htmltext.main_text("".join(bits[i] for i in r.integers(0, len(bits), 20))), str)
    assert htmltext.main_text("<p>a<![foo[ x ]]>b</p>") == "ab" and htmltext.main_text("a<![ foo") == "a"
    took = []
    for n in (10_000, 80_000):
        for page in ("<b>" * n + "<div>x" * n, "<p><div>" + "<b>" * n + "<h1>x" * n, "<div class=related>x" * n, "<td><th><li>x" * n, "</i>" * n + "x"):
            start = time.process_time()
            htmltext.main_text(page)
            took.append(time.process_time() - start)
    assert all(b < 25 * a + 1 for a, b in zip(took[:5], took[5:], strict=True))


def test_language_held_out(spark, documents):
    got = langid.op10(spark, documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_language_scores_equal_counting():
    texts = ["Hallo Welt", "a", "", None, "xyz  xyz!"]
    g, d, letters = langid.grams(texts)
    alone = [langid.grams([t])[0].tolist() for t in texts]
    assert [sorted(g[d == i].tolist()) for i in range(5)] == [sorted(a) for a in alone] and letters.tolist() == [True, True, False, False, True]


def test_language_posterior_equals_plain_counting(spark):
    """Two small languages: the posterior of add-half multinomial counts over hashed grams, gram by gram."""
    rows = [(1, "ab abc bad", "x"), (2, "cab cabbage", "x"), (3, "zig zag zoo", "y"), (4, None, "x"), (5, "none", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, logp = langid.train_langid(df)
    n = {k: Counter() for k in ("x", "y")}
    for _, text, lang in rows:
        if lang and text:
            n[lang].update(langid.grams([text])[0].tolist())
    asked = ["abba", "zap", "the cab zag"]
    got = langid.predict_langid(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string"), names, logp).orderBy("doc_id").collect()
    for t, r in zip(asked, got, strict=True):
        ll = {k: sum(np.log((c[g] + 0.5) / (c.total() + 0.5 * langid.BUCKETS)) for g in langid.grams([t])[0].tolist()) for k, c in n.items()}
        top = max(ll, key=ll.get)
        assert r["lang_id"]["lang"] == top and abs(r["lang_id"]["score"] - 1 / sum(np.exp(v - ll[top]) for v in ll.values())) < 1e-4


def test_more_languages_than_a_block_are_scored_alike(spark, documents, monkeypatch):
    """Blocks of two languages with a pass each give the languages and posteriors of one matrix."""
    usable = documents.where("doc_id % 3 = 0 OR text IS NULL")
    want = langid.op10(spark, usable).toPandas().set_index("doc_id").sort_index()
    monkeypatch.setattr(langid, "BLOCK", 2)
    assert len(list(langid.language_blocks(usable))) > 1
    got = langid.op10(spark, usable).toPandas().set_index("doc_id").sort_index()
    assert len(got) == len(want) > 100 and (got["lang_pred"] == want["lang_pred"]).all() and np.allclose(got["score"], want["score"], atol=1e-9)


def test_blocks_of_languages_in_small_cases(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 1)
    rows = [(1, "aaa bbb", "x", 1), (2, "aaa bbb", "y", 2), (3, "zzz", "z", 3), (4, None, "x", 4), (5, "12", None, 5), (5, "aaa", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _best int")
    got = langid.identify(df, langid.language_blocks(df))
    assert got.columns == [*df.columns, "lang_id"]
    by_text = {r["text"]: (r["lang_id"]["lang"], r["lang_id"]["score"]) for r in got.collect()}
    assert got.count() == 6 and by_text[None] == by_text["12"] == ("und", 0.0) and by_text["zzz"][0] == "z"
    assert by_text["aaa bbb"][0] == "x"  # the first of those that tell no more
    assert langid.identify(df.limit(0), langid.language_blocks(df)).count() == 0 == langid.identify(df.limit(0), langid.language_blocks(df.limit(0))).count()


def test_pipeline_stages(spark, labelled):
    import corpus_pipeline as cp

    got = cp.run(spark, SF).toPandas()
    docs, kept = table(spark, SF, "documents"), set(got["doc_id"])
    q = quality.score_quality(docs, quality.train_quality(docs, table(spark, SF, "labels")), "q").where("q >= 0.3").select(*docs.columns)
    t = cp.drop_toxic(spark, q, SF)
    classes = brute_classes(t.select("doc_id", "text").orderBy("doc_id").collect())
    assert kept == set(classes.values()) and q.columns == t.columns == docs.columns
    sums = got.groupby("doc_id")["length"].sum()
    assert (sums == got.groupby("doc_id")["doc_tokens"].first()).all()
    good = labelled[(labelled["quality"] == 1) & (labelled["toxic"] == 0)].index
    assert len(set(good) & {r["doc_id"] for r in t.select("doc_id").collect()}) / len(good) > 0.97
