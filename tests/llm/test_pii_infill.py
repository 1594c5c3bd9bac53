"""Personal data and fill-in-middle, against brute force over whole tables and odd texts."""

import hashlib
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import infill, pii, queries
from gridloom.llm.common import table

SF = "/root/testdata/sf0.01"
GOOD_CARD = "4765757300669737"
ODD = [
    None, "", " ", "a@b.c", "a@b", "@b.c", "a@b.c@d.e", "a@b@c.d", "x@y.z.", "a@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "1" * 5000 + ".1.1.1", "4" * 50,
    "4111 1111 1111 1111", "4111-1111-1111-1111 5500000000000004", "+1 (743) 555-3824", "+1 (743) 555-3824 +44 20 7946 0958", "+1 555", "++1 555 555 5555", "+1((((((", "a\n<P>b", "<S>", "<M>\n", "\n\n\n",
    "one\ntwo", "one\ntwo\n", "é\nü\n\U0001f600", "\r\n\r", "a@b.c " * 2000, "1 " * 3000, "+1 2 3 " * 500,
]


def plain_base(text):
    """The base rules as plain expressions over the whole text."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(p.strip("0") == "" or (len(p.lstrip("0")) < 4 and int(p) <= 255) for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m.group())][::-1]
        if 12 <= len(d) <= 19 and sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, k) for a, k, b in sorted(out)]


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in spans)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_base_spans_of_odd_and_random_texts():
    r = random.Random(5)
    texts = [t for t in ODD if t] + ["".join(r.choices("a1.@+-() 2é\n", k=r.randint(1, 60))) for _ in range(20_000)]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t


def test_every_document_has_the_base_spans_and_no_text_loses_one(spark):
    docs = table(spark, SF, "documents")
    text = docs.toPandas().set_index("doc_id")["text"]
    got = pii.op11(spark, docs).toPandas().set_index("doc_id")
    assert len(got) == len(text)
    for i, row in got.iterrows():
        want = plain_base(text[i] or "")
        assert row["base_sha256"] == sha(joined(want))
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == n for s in want) for n in range(4)]
        spans = row["spans"].split(",") if row["spans"] else []
        assert set(joined(want).split(",") if want else []) <= set(spans) and len(spans) == len(want) + row["n_added"]
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))


def test_the_trees_find_what_stands_side_by_side_and_leave_decoys(spark):
    models = pii.train_pii(table(spark, "/root/testdata/sf0.1", "documents"))
    finder = pii.Finder(models)
    r = random.Random(3)

    def card(good):
        while True:
            d = "".join(r.choices("0123456789", k=16))
            if pii.luhn(d) == good:
                return d

    phone = lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(0, 9999):04d}"
    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    caught, false = 0, 0
    for _ in range(200):
        p, a, c = phone(), ip(), card(True)
        text = f"the words of {p} {a} and of {c} {card(False)} here"
        base = pii.base_spans(text)
        got = {(x, y, k) for x, y, k, _, _ in finder.find([text])[0]}
        want = {(text.index(s), text.index(s) + len(s), k) for s, k in ((p, pii.PHONE), (a, pii.IP), (c, pii.CARD))}
        caught += len(want & got)
        false += len(got - want - set(base))
        assert not finder.find([f"ordinary words, {card(False)} and 12.5 of 2024-01-15, page 3-4 (17)"])[0]
    assert caught >= 590 and false <= 2
    for extra in ("write to jane.doe[at]mail3 [dot] example [dot] com now", "write to josé@mail3.example.com now"):
        assert [s[2] for s in finder.find([extra])[0]].count(pii.EMAIL) == 1, extra


def test_boosting_and_calibration():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.2) & (x[:, 3] < 0.5)).astype(float)
    m = pii.boost(x[:2000], y[:2000])
    pii.calibrate(m, x[2000:], y[2000:], 0.98)
    p = m.p(x[2000:])
    on = p >= m.threshold
    assert ((p > 0.5) == y[2000:]).mean() > 0.98 and y[2000:][on].mean() >= 0.98 and y[2000:][on].sum() > 0.9 * y[2000:].sum()
    assert abs(p.mean() - y[2000:].mean()) < 0.02
    one = np.array([m.start + sum(v[walk(f, t, q)] for f, t, v in zip(m.feature, m.at, m.value, strict=True)) for q in x[:50]])
    assert np.allclose(one, m.raw(x[:50])) and len(pii.Trees().p(np.zeros((0, 3)))) == 0


def walk(f, t, x):
    node = 0
    while node < len(f):
        node = 2 * node + 1 + (x[f[node]] > t[node])
    return node - len(f)


def test_redaction():
    assert pii.redact("ab cd ef", [(3, 5, "ip"), (4, 6, "card")]) == "ab [ip]ef" and pii.redact("", []) == ""


def odd_docs(spark):
    rows = [(i if i % 7 else None, t, i, "x") for i, t in enumerate(ODD)] + [(3, "a@b.c", 3, "x"), (3, "a@b.c", 3, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, pii int, infill string")


def test_odd_documents(spark):
    docs = odd_docs(spark)
    got = pii.op11(spark, docs).toPandas()
    want = sorted(sha(joined(plain_base(t or ""))) for t in [*ODD, "a@b.c", "a@b.c"])
    assert sorted(got["base_sha256"]) == want
    assert pii.op11(spark, docs.limit(0)).count() == 0
    out = pii.find_pii(docs, [pii.Trees()] * 4)
    assert out.columns == docs.columns and out.count() == len(want)
    odd = infill.op12(spark, docs).toPandas()
    check_infill(docs.toPandas(), odd)
    assert infill.op12(spark, docs.limit(0)).count() == 0
    assert infill.fill_in_middle(docs).columns == docs.columns


def check_infill(docs, got):
    """Every row against a plain version with a list of all units."""
    want = []
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        key = "" if i != i or i is None else str(int(i))
        t = t or ""
        d = sha(f"7:{key}")
        h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
            want.append((key, n, "plain", None, None, sha(t), sha(t)))
        elif h[3] % 100 < 50:
            want.append((key, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)))
        else:
            want.append((key, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)))
    none = lambda v: None if v != v or v is None else int(v)
    have = [("" if none(r.doc_id) is None else str(int(r.doc_id)), r.n, r.form, none(r.prefix_chars), none(r.middle_chars), r.output_sha256, r.restored_sha256) for r in got.itertuples()]
    assert sorted(map(str, have)) == sorted(map(str, want))


def test_infill_of_every_document_by_sql_and_by_lists(spark):
    docs = table(spark, SF, "documents")
    got = queries.op12_fill_in_middle(spark, SF).toPandas()
    check_infill(docs.toPandas(), got)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.execute(queries.ORACLE_SQL["op12_fill_in_middle"]).df()
    order = lambda d: d[sorted(d.columns)].sort_values("doc_id").astype(str).reset_index(drop=True)
    assert order(got).equals(order(want))
    assert set(got["form"]) == {"psm", "spm"}


def test_other_units_rates_and_round_trips(spark):
    docs = table(spark, SF, "documents").limit(200)
    for how in (infill.Infill(1, 40, 100, r"\S+\s*"), infill.Infill(2, 100, 0, r"(?s).")):
        got = infill.fill_in_middle(docs, how, "f").select("text", "f.*", infill.restore(F.col("f.output"), F.col("f.form")).alias("back")).toPandas()
        assert (got["back"] == got["text"]).all() and set(got["form"]) == ({"spm", "plain"} if how.rate == 40 else {"psm"})


def test_the_second_pass_is_lazy():
    """A text of two million units is cut without an array of them."""
    import tracemalloc

    text, unit = "\n" * 2_000_000, re.compile(infill.LINES)
    tracemalloc.start()
    assert infill.cut_at(text, unit, 1_500_000, 700_000) == (2_000_000, 700_000, 1_500_000)
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
