import datetime as dt
import random

from pyspark.sql import functions as F

from canonspark.llm import url_filters as U

D = dt.date(2024, 1, 1)


def day(i):
    return D + dt.timedelta(days=i)


def standing(entries, lst, pattern, when):
    """The entry's state at the end of day ``when``, change by change."""
    on = False
    for d in sorted({e[2] for e in entries if e[0] == lst and e[1] == pattern and e[2] <= when}):
        acts = {e[3] for e in entries if (e[0], e[1], e[2]) == (lst, pattern, d)}
        on = "remove" not in acts
    return on


def test_equals_replaying_every_change(spark):
    rng = random.Random(1)
    hosts = ["a.com", "x.a.com", "b.org", "c.b.org", "hot.net"]
    paths = ["", "p", "p/q", "p/qq", "r"]
    pats = hosts + ["com", "a.com/p", "x.a.com/p", "hot.net/p/q", "b.org/r"]
    entries = [(rng.choice("LM"), rng.choice(pats), day(rng.randint(0, 30)), rng.choice(["add", "add", "remove"]))
               for _ in range(150)]
    caps = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'u@'])}{h}{rng.choice(['', ':80'])}/{p}"
                f"{rng.choice(['', '?a=/b', '#f', '/'])}", h, p, day(rng.randint(-2, 33)))
            for i in range(300) for h, p in [(rng.choice([*hosts, *["hot.net"] * 3]), rng.choice(paths))]]
    df = spark.createDataFrame(caps, "page_id long, url string, h string, p string, fetched date")
    df = df.withColumn("list", F.lit(1)).withColumn("pattern", F.lit("x")).withColumn("url_filter", F.lit(0))
    ent = spark.createDataFrame(entries, "list string, pattern string, day date, action string")
    for r in U.judge(df, ent).collect():
        segs = r["p"].split("/") if r["p"] else []
        labels = r["h"].split(".")
        cover = [".".join(labels[i:]) for i in range(len(labels))]
        cover += ["/".join([r["h"], *segs[:i + 1]]) for i in range(len(segs))]
        want = sorted(f"{x}:{q}" for x in "LM" for q in cover if standing(entries, x, q, r["fetched"]))
        got = r["url_filter"]
        assert got["patterns"] == want and got["host"] == r["h"] and got["blocked"] == bool(want)
        assert got["lists"] == sorted({w[0] for w in want})


def test_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([], "list string, pattern string, day date, action string")
    caps = spark.createDataFrame([(1, None, D), (2, "no url", D), (3, "http://a.b/c", None), (4, "http://a.b/c", D),
                                  (4, "http://a.b/c", D)], "page_id long, url string, fetched date")
    got = U.judge(caps, none).collect()
    assert len(got) == 5 and not any(r["url_filter"]["blocked"] for r in got)
    bad = spark.createDataFrame([("L", "a.b", D, None), ("L", None, D, "add"), ("L", "b", D, "add"),
                                 (None, "a.b", D, "add"), ("L", "a.b", None, "add")],
                                "list string, pattern string, day date, action string")
    got = U.judge(caps, bad).collect()
    assert sorted(r["page_id"] for r in got if r["url_filter"]["blocked"]) == [4, 4]
    assert U.judge(caps.limit(0), bad).count() == 0


def test_plan_has_no_python(spark):
    caps = spark.createDataFrame([(4, "http://a.b/c", D)], "page_id long, url string, fetched date")
    ent = spark.createDataFrame([("L", "b", D, "add")], "list string, pattern string, day date, action string")
    plan = U.judge(caps, ent)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
