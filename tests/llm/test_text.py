import re

import numpy as np
import pytest

from mesoflow.llm import leakage, mixing, stuffing

RNG = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(400)]


def said(n):
    return " ".join(RNG.choice(WORDS, n))


# ---- leaked items


def words(t):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", t)]


def brute(docs, items, n=20):
    out = set()
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def corpus():
    items = [(i, said(int(RNG.integers(5, 90)))) for i in range(40)] + [(90, None), (91, ""), (92, "")]
    shared = said(30)
    items += [(93, said(7) + " " + shared), (94, shared + " " + said(9)), (95, "ab " * 60)]
    docs = []
    for d in range(60):
        parts = [said(int(RNG.integers(0, 60)))]
        for _ in range(3):
            w = words(items[int(RNG.integers(0, 40))][1])
            a = int(RNG.integers(0, max(1, len(w) - 15)))
            cut = w[a : a + int(RNG.integers(15, 30))]
            parts += [" ,\n".join(x.upper() if RNG.random() < 0.3 else x for x in cut), "é — " + said(4)]
        docs.append((d, " ".join(parts)))
    docs += [(60, None), (61, ""), (62, "x" * 300_000), (63, "ab " * 45), (64, "ab-" * 19), (65, shared), (66, ("zz " * 200_000) + shared)]
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id bigint, item_text string, text string")
    rows = leakage.leaked_items(d, e).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == brute(docs, items)
    texts, own = dict(docs), dict(items)
    for r in rows:
        passage = words(texts[r["doc_id"]][r["start"] : r["end"]])
        assert len(passage) == r["n_words"]
        assert passage == words(own[r["item_id"]])[r["item_word"] : r["item_word"] + r["n_words"]]


def test_many_items_are_one_scan(spark):
    """Five megabytes of items: one automaton, and one pass over the documents in the plan."""
    big = [(i, " ".join(f"{x:x}" for x in np.random.default_rng(i).integers(0, 1 << 30, 60))) for i in range(10_000)]
    assert sum(len(t) for _, t in big) > 4 << 20
    docs = [(i, "so " + big[i * 7][1].upper()) for i in range(50)] + [(99, "none of these")]
    e = spark.createDataFrame(big, "item_id bigint, item_text string")
    leaks = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), e)
    assert leaks._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r["doc_id"], r["item_id"]) for r in leaks.collect()} == {(i, i * 7) for i in range(50)}


def test_leaks_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    e = spark.createDataFrame([], "item_id bigint, item_text string")
    assert leakage.leaked_items(d, e).count() == 0
    assert leakage.leaked_items(spark.createDataFrame([(1, "a b")], d.schema), e).count() == 0


# ---- mixing


def test_shares_are_filled_up_to_the_caps():
    take = mixing.plan_shares({"a": 100, "b": 10, "c": 1000}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 5), "gone": (0.1, 3)}, 500)
    assert take == {"a": 100.0, "b": 20.0, "c": 380.0, "gone": 0.0}
    assert sum(mixing.plan_shares({"a": 10}, {"a": (1.0, 1)}, 500).values()) == 10


@pytest.mark.parametrize("knots", [[(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.0), (0.5, 2.0), (1.0, 1.0)], [(0.0, 2.0), (1.0, 0.0)]])
def test_demand_is_inverted(spark, knots):
    from pyspark.sql import functions as F

    x = np.linspace(0, 1, 2001)
    w = np.interp(x, *zip(*knots))
    total = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(x))])
    done = [0.0, 0.1, 0.33, 0.5, 0.77, 1.0]
    df = spark.createDataFrame([(v,) for v in done], "d double")
    got = [r["p"] for r in df.select(mixing.demand_inverse(F.col("d"), knots).alias("p")).collect()]
    assert got == pytest.approx(np.interp(np.array(done) * total[-1], total, x).tolist(), abs=2e-3)


def test_mix_keeps_caps_shares_and_order(spark):
    rows = [(i, s, int(n)) for s, k in (("a", 300), ("b", 40), ("c", 500)) for i, n in zip(range(k), RNG.integers(1, 90, k))]
    rows = [(1000 * "abc".index(s) + i, s, n) for i, s, n in rows] + [(9000, None, 50), (9001, "unlisted", 70), (9002, "a", None), (9003, "a", 0)]
    t = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.3, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    total = sum(n or 0 for _, _, n in rows)
    for buckets in (1, 16):
        m = mixing.mix(t, targets, {"b": [(0.0, 0.0), (1.0, 2.0)]}, buckets=buckets)
        got = m.collect()
        uses = {}
        for r in got:
            uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
        caps = {"a": 1, "b": 3, "c": 2}
        assert all(n <= caps["abc"[d // 1000]] for d, n in uses.items())
        assert [r["position"] for r in got] == sorted(r["position"] for r in got)
        assert abs(sum(r["tokens"] for r in got) - total) <= 3 * 90
        rep = {r["source"]: r for r in mixing.share_report(m, targets, t).collect()}
        assert rep["b"]["most_copies"] == 3 and rep["none"]["tokens_used"] == 0
        assert sum(r["actual_share"] for r in rep.values()) == pytest.approx(1)
    assert mixing.mix(t.where("false"), targets).count() == 0


def test_tokens_of_pieces_add_up(spark, monkeypatch):
    text = "The quick brown fox, 12 jumps  over\n\nlazy dogs' tails. " * 300
    df = spark.createDataFrame([(1, "a", text), (2, "a", None), (3, "a", "")], "doc_id bigint, source string, text string")
    whole = {r["doc_id"]: r["tokens"] for r in mixing.token_counts(df).collect()}
    assert whole[2] is None and whole[3] == 0
    monkeypatch.setattr(mixing, "PIECE", 500)
    assert len(list(mixing._pieces(text))) > 10 and "".join(mixing._pieces(text)) == text
    assert {r["doc_id"]: r["tokens"] for r in mixing.token_counts(df).collect()} == whole


# ---- stuffed pages

SENTENCES = "This tool reads one file. It writes another file to the disk. Nothing else is changed by it."
SPAM = {
    "keywords": "\n".join("cheap zorbo best zorbo buy zorbo online zorbo sale cheap zorbo deal" for _ in range(12)),
    "commas": ", ".join(["cheap zorbo", "zorbo sale", "buy zorbo now"] * 20),
    "semicolons": "; ".join(["cheap zorbo", "zorbo sale", "buy zorbo now"] * 20),
    "tags": "\n".join("#zorbo #cheap_zorbo #buyzorbo #zorbosale" for _ in range(8)),
    "links": "\n".join(f"https://a{i}.example/x/{i}.html" for i in range(30)),
    "anchors": "<html><body>\n" + "\n".join(f'<li><a href="https://a{i}.example/x">zorbo sale</a></li>' for i in range(30)) + "\n</body></html>",
    "package": '{"name": "zorbo", "version": "1.0.0", "description": "' + "cheap zorbo buy zorbo " * 15 + 'sale", "keywords": [' + ", ".join(['"cheap zorbo"', '"zorbo"'] * 25) + "]}",
    "comment": 'print("x")\n' + "\n".join("# cheap zorbo best zorbo buy zorbo online zorbo" for _ in range(15)),
}
PLAIN = {
    "text": "\n\n".join([SENTENCES] * 6),
    "explained links": "\n".join(f"- [tool{i}](https://a{i}.example/x): {SENTENCES}" for i in range(12)),
    "change log": "\n".join(f"* 1.{i}: Fixed a fault in the reader. ([#{i}](https://a.example/{i}))" for i in range(30)),
    "code": "\n".join(f"def f{i}(a, b):\n    if a > {i}:\n        return a + b * {i}" for i in range(20)),
    "settings": "\n".join(f"part{i}:\n  - thing{i}\n  - other{i}\n  size: {i}" for i in range(20)),
    "table": "id,x,y,label\n" + "\n".join(f"{i},0.{i},0.{i * 7},thing" for i in range(60)),
    "words in code": "WORDS = [\n" + "\n".join(f'    "{a}{b}",' for a in "abcdefgh" for b in "klmnop") + "\n]",
    "addresses in code": "HOSTS = [\n" + "\n".join(f'    "https://a{i}.example/x",' for i in range(30)) + "\n]\nfor h in HOSTS:\n    fetch(h)\n" + "x = f(1)\n" * 60,
    "translation": "\n".join(f'key_{i}: "The file {i} could not be read from the disk."' for i in range(30)),
    "minified": "var a=1;function b(c,d){return c+d};" * 40,
    "empty": "",
    "blank": " \n\n ",
}


def test_stuffed_pages_are_told_from_others(spark):
    pages = list(SPAM.items()) + list(PLAIN.items())
    rows = [(i, t, 5) for i, (_, t) in enumerate(pages)] + [(99, None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shape int")
    got = {pages[r["doc_id"]][0] for r in stuffing.stuffed_pages(df).collect()}
    assert got == set(SPAM)
    crlf = df.selectExpr("doc_id", "replace(text, '\n', '\r\n') as text")
    assert {pages[r["doc_id"]][0] for r in stuffing.stuffed_pages(crlf).collect()} == set(SPAM)
    assert stuffing.stuffed_pages(df.where("false")).count() == 0


SHOES = {
    "capitals": "\n".join(["Cheap Shoes, Buy Shoes, Best Shoes"] * 40),
    "one capital": "\n".join(["Cheap shoes, buy shoes, best shoes"] * 40),
    "capitals in links": "\n".join(f"[Best Shoes](http://a{i}.example/x)" for i in range(60)),
    "capitals by links": "\n".join(f"Cheap Shoes http://a{i}.example/x" for i in range(60)),
}
PROSE = """the morning was cold and the streets were empty when we left the house, and nobody said a word until we came to the bridge.
there we stopped for a while and looked at the water, which was high for the time of the year and had taken the path by the mill.

in the end we went back the same way as we had come, because the road on the other side of the river was closed by the town
and it had begun to rain again. my brother said that we should have stayed at the house, and i think that he was right about it."""


def test_capitals_and_lower_case_prose(spark):
    pages = [*SHOES.items(), ("prose", PROSE), ("prose again", "\n\n".join([PROSE] * 9)), ("prose of long lines", PROSE.replace("\n", " ") * 3)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(pages)], "doc_id bigint, text string")
    assert {pages[r["doc_id"]][0] for r in stuffing.stuffed_pages(df).collect()} == set(SHOES)


def test_long_page(spark):
    df = spark.createDataFrame([(1, SPAM["keywords"] * 400), (2, PLAIN["text"] * 400)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in stuffing.stuffed_pages(df).collect()] == [1]


def test_queries_equal_their_sql(spark, sf_dir):
    from oracle import duck_rows, spark_rows

    from mesoflow.llm.queries import QUERIES, SQL

    for name, sql in SQL.items():
        assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(sql, sf_dir)


def test_queries_over_the_tables(spark, sf_dir):
    from mesoflow.llm.queries import QUERIES

    import duckdb

    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, item_text from '{sf_dir}/eval_items.parquet'").fetchall()
    assert {tuple(r) for r in QUERIES["p6_found"](spark, sf_dir).collect()} == brute(docs, items)
    for name in ("p6_items", "p7_mix", "p7_shares"):
        assert QUERIES[name](spark, sf_dir).count() > 0
    assert QUERIES["p8_found"](spark, sf_dir).columns == ["doc_id"]
