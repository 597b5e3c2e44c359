"""Merge, acceptance, history, selection and the feed against short sequential models."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from contactloom import ship
from contactloom.functions import listings as L
from contactloom.operators import enrich as N, history as Hist, merge as M, select as S
from contactloom.plans import inputs as I
from contactloom.sources import history as SH, listings as SL, pages as SP
from contactloom.sources.commits import Commits
from contactloom.sources.schema import LEAD_SCHEMA, as_leads
from contactloom.streaming.feed import Feed, distinct_keys

SF = "/root/testdata/sf0.001"
ROW = "seq bigint, name string, website string, address string, source string, place_id string, lat double, lon double"


def model_targets(rows):
    """The documented rules, one row after the other: r is (seq, name, website, address, source, place_id, lat, lon)."""
    out, by_key, first = {}, {}, {}
    for r in sorted(rows):
        name = r[1].lower()
        key = f"{r[2]}|{name}" if r[2] else f"{name}|{r[3].lower()}"
        a = first.get(name)
        near = a is not None and not (a[5] and r[5] and a[4] == r[4]) and None not in (a[6], r[6]) and abs(a[6] - r[6]) < 0.003
        target = by_key.get(key) or (a[0] if near else None)
        if target is None:
            target = r[0]
            by_key[key] = r[0]
            first.setdefault(name, r)
        out[r[0]] = target
    return out


row = st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["", "x.it", "y.it"]), st.sampled_from(["", "p"]), st.sampled_from(["s", "t"]), st.sampled_from(["", "1", "2"]), st.sampled_from([None, 1.0, 1.002, 1.004]))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=14))
def test_merge_targets(spark, rows):
    rows = [(i + 1, n, w, a, s, p, x, x) for i, (n, w, a, s, p, x) in enumerate(rows)]
    df = as_leads(spark.createDataFrame(rows, ROW).repartition(3))
    assert {r.seq: r.target for r in M.with_target(df).collect()} == model_targets(rows)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(0, 8), min_size=1, max_size=3), min_size=1, max_size=14))
def test_acceptance_is_greedy_not_transitive(spark, values):
    ids = [(i, "f", str(v)) for i, vs in enumerate(values) for v in vs]
    want, taken = set(), set()
    for i, vs in enumerate(values):
        if not taken & set(vs):
            want.add(i)
            taken |= set(vs)
    got = S.first_of_each(spark.createDataFrame(ids, "seq bigint, field string, value string"))
    assert {r.seq for r in got.collect()} == want


def test_merge_fills_gaps(spark):
    df = spark.createDataFrame([(1, "A", "", "", "s", "", None, None), (2, "A", "", "Road", "t", "", None, None), (3, "A", "", "", "s", "", None, None)], ROW)
    df = as_leads(df, raw_phones=F.array(F.lit("+1 234 567 8901"), F.concat(F.lit("n"), F.col("seq").cast("string"))), socials=F.create_map(F.lit("facebook"), F.col("seq").cast("string")))
    (r,) = M.merge_leads(df).collect()
    assert (r.seq, r.address, r.source, r.raw_phones, r.socials) == (1, "Road", "s + t", ["+1 234 567 8901", "n1", "n2", "n3"], {"facebook": "1"})
    assert M.merge_leads(df.limit(0)).count() == 0


def lead(spark, *rows):
    """(seq, category, phone, email, website)"""
    df = spark.createDataFrame(list(rows), "seq bigint, category string, phone string, email string, website string")
    return as_leads(df, name=F.concat(F.lit("n"), F.col("seq").cast("string"))).withColumn("lead_key", L.lead_key(F.col("name"), F.col("website"), F.col("raw_phones"), F.col("address")))


def test_phone_identifies_only_without_website(spark):
    rows = [(1, "c", "+1", "", ""), (2, "c", "+1", "", ""), (3, "c", "+1", "", "http://x.it"), (4, "c", "+1", "", "http://y.it")]
    assert sorted(r.seq for r in S.accept(lead(spark, *rows), None).collect()) == [1, 3, 4]


def test_overshoot_of_a_category_blocks_nothing(spark):
    rows = [(1, "a", "+1", "", ""), (2, "a", "+2", "", ""), (3, "b", "+2", "", ""), (4, "b", "+1", "", "")]
    assert sorted(r.seq for r in S.accept(lead(spark, *rows), 1, ["a", "b"]).collect()) == [1, 3]


def test_need_email_looks_at_the_twin_sets(spark):
    leads = lead(spark, (1, "c", "+1", "", ""), (2, "c", "+2", "b@x.it", ""))
    history = spark.createDataFrame([("phones", "+1"), ("e_phones", "+2")], "field string, value string")
    assert [r.seq for r in Hist.known(leads, history).collect()] == [1]
    assert [r.seq for r in Hist.known(leads, history, need_email=True).collect()] == [2]
    assert Hist.unseen(leads, history, include_seen=True).count() == 2
    new = {(r.field, r.value) for r in Hist.to_remember(leads, history).collect()}
    assert ("emails", "b@x.it") in new and ("e_keys", "n2|") in new and ("phones", "+1") not in new and ("e_phones", "+1") not in new


def test_history_tables(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.createDataFrame([("phones", "+1"), ("keys", "x.it|n"), ("emails", "a@mail.x.it")], "field string, value string")
    SH.save_history(rows, path, "r1")
    SH.save_history(rows.limit(1), path, "r2")
    good, bad = SH.read_history(spark, path)
    assert good.count() == 3 and bad.count() == 0
    assert ("e_keys", "x.it|n") in {tuple(r) for r in SH.migrate(good).collect()}
    SH.reset_history(spark, path)
    assert SH.read_history(spark, path)[0].count() == 0
    (tmp_path / "old.json").write_text('{"ids": ["a"], "phones": ["+1", ""]}')
    (tmp_path / "bad.json").write_text('{"ids": 7')
    (tmp_path / "list.json").write_text('["a"]')
    odd = {"number": '{"ids": 7, "phones": ["+2"]}', "mixed": '{"ids": [7, "x"], "phones": ["+2"]}', "absent": '{"ids": ["x"], "phones": null}', "numbers": '{"ids": [1, 2]}', "hole": '{"ids": ["x", null]}', "nothing": "null", "words": '"ids"'}
    for name, value in odd.items():
        (tmp_path / f"{name}.json").write_text(value)
    (tmp_path / "empty.json").write_text('{"ids": [], "other": 5, "e_ids": ["z"]}')
    assert {tuple(r) for r in SH.read_legacy(spark, str(tmp_path / "empty.json"))[0].collect()} == {("e_ids", "z")}
    assert {tuple(r) for r in SH.read_legacy(spark, str(tmp_path / "old.json"))[0].collect()} == {("ids", "a"), ("phones", "+1")}
    for name in ("bad", "list", *odd):
        good, aside = SH.read_legacy(spark, str(tmp_path / f"{name}.json"))
        assert good.count() == 0 and [r.value for r in aside.collect()] == [(tmp_path / f"{name}.json").read_text()]


def test_a_commit_is_whole_or_absent(spark, tmp_path):
    """A writer that dies between two tables leaves nothing that is read; the next try takes its place."""
    commits = Commits(spark, str(tmp_path / "c"))
    one, two = spark.range(3), spark.range(5)
    commits.commit("a", {"x": one, "y": two})
    broken = spark.range(1).select(F.raise_error(F.lit("died")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="died"):
        commits.commit("a", {"x": two, "y": broken})
    with pytest.raises(Exception, match="died"):
        commits.commit("b", {"x": two, "y": broken})
    assert (commits.read("x", "id bigint").count(), commits.read("y", "id bigint").count()) == (3, 5)
    commits.commit("b", {"x": two, "y": one})
    commits.commit("a", {"x": spark.range(1), "y": one})
    assert (commits.read("x", "id bigint").count(), commits.read("x", "id bigint", "a").count()) == (6, 5)
    commits.reset()
    assert commits.read("x", "id bigint").count() == 0


def test_commits_are_folded(spark, tmp_path, monkeypatch):
    """Many commits become few, whole at any moment, also if the old manifests were not deleted; the last one may come again."""
    commits, seen = Commits(spark, str(tmp_path / "c")), []
    for i in range(1, 12):
        commits.commit(f"k{i:03d}", {"x": spark.range(i)})
        if i == 11:
            with monkeypatch.context() as m:  # dies after the new manifest, before the old ones are gone
                m.setattr(Commits, "_fs", lambda self, real=Commits._fs: NoDelete(real(self)))
                commits.fold({"x": "id bigint"}, 2, f"k{i:03d}")
        else:
            commits.fold({"x": "id bigint"}, 3, f"k{i:03d}")
        seen.append(len(commits.manifests()))
        assert commits.read("x", "id bigint").count() == i * (i + 1) // 2
    assert max(seen) <= 6
    commits.commit("k011", {"x": spark.range(1)})
    assert commits.read("x", "id bigint").count() == 56
    assert commits.read("x", "id bigint", "k011").count() == 55


class NoDelete:
    def __init__(self, fs):
        self.fs = fs

    def __getattr__(self, name):
        return getattr(self.fs, name)

    def delete(self, *_):
        return False


def model_feed(batches, history, n):
    """Batches of (key, phone, email), no websites and no gaps to fill, one after the other: keys accepted, and what is learned."""
    hist, run, seen, won, new = set(history), set(), set(), [], set()
    for batch in batches:
        fresh = [r for r in batch if r[0] not in seen and not seen.add(r[0]) and ("keys", r[0]) not in hist | run]
        for r in fresh:
            ids = {i for i in (("keys", r[0]), ("phones", r[1]), ("emails", r[2])) if i[1]}
            if len(won) == n or not (r[1] or r[2]) or ids & run or (ids & hist and not r[2]):
                continue
            new |= ids | {(f"e_{f}", v) for f, v in ids if r[2] and f != "emails"}
            if ids & hist:
                hist |= ids
                continue
            won.append(r[0])
            run |= ids
    return won, new - set(history)


def test_feed_enriches_and_learns(spark, tmp_path):
    rng = random.Random(28)  # with it, rows go for what was learned only
    batches = [{f"n{rng.randrange(60):02d}": (rng.choice(["", f"+44{rng.randrange(30)}"]), rng.choice(["", f"{rng.randrange(30)}@x.it"])) for _ in range(12)} for _ in range(5)]
    history = [("phones", f"+44{i}") for i in range(12)] + [("keys", "n07|a"), ("emails", "3@x.it")]
    enrich = lambda df: df.withColumns({c: F.substring(F.get("raw_emails", F.lit(i)), 2, 99) for i, c in enumerate(("phone", "email"))})
    for n in (None, 8):
        feed = Feed(spark, str(tmp_path / f"f{n}"), spark.createDataFrame(history, "field string, value string"), enrich, n=n, fold=2)
        for b, part in enumerate(batches):
            rows = [(100 * b + i, name, "a", [f"p{phone}", f"e{email}"]) for i, (name, (phone, email)) in enumerate(part.items())]
            feed.take(as_leads(spark.createDataFrame(rows, "seq bigint, name string, address string, raw_emails array<string>")), b)
        won, new = model_feed([[(f"{name}|a", *v) for name, v in part.items()] for part in batches], history, n)
        assert len({v for f, v in new if f == "keys"} - set(won)) >= 7  # learned
        assert sorted(r.lead_key for r in feed.accepted().collect()) == sorted(won)
        assert {tuple(r) for r in feed.remembered().collect()} == new


def test_bucketed_history_stays_where_it_is(spark):
    leads = I.delivered(spark, SF)
    history = Hist.identities(leads).where("seq % 3 = 0").select("field", "value")
    table = SH.save_bucketed(history, "bucketed_history", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = Hist.known(leads, table)
        plan = seen._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("bucketed_history") - 400 : plan.index("bucketed_history")].splitlines()
        assert "SortMergeJoin" in plan and not any("Exchange" in x for x in side[-3:])
        assert {r.seq for r in seen.collect()} == {r.seq for r in Hist.known(leads, history).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_history")


def test_many_areas_equal_the_comparison_of_all(spark):
    rng = random.Random(2)
    points = [(i, rng.choice([None, rng.uniform(-2, 2), 0.0]), rng.uniform(-2, 2)) for i in range(300)]
    boxes = [(i, s := rng.uniform(-2, 2), w := rng.uniform(-2, 2), s + rng.choice([0, 0.01, 0.3, 3]), w + rng.choice([0, 0.05, 2])) for i in range(80)]
    df = spark.createDataFrame(points, "seq int, lat double, lon double")
    got = SL.in_areas(df, spark.createDataFrame(boxes, "area int, south double, west double, north double, east double"), 0.02).collect()
    assert sorted((r.seq, r.area) for r in got) == sorted((i, a) for i, y, x in points for a, s, w, n, e in boxes if y is not None and s <= y <= n and w <= x <= e)


def test_many_rows_at_one_place_are_compared_by_many_tasks(spark):
    df = spark.range(0, 12_000, 1, 1).select(F.col("id").alias("seq"), F.lit(45.0).alias("lat"), F.when(F.col("id") < 9_000, 8.0).otherwise(8.5).alias("lon"), F.create_map(F.lit("k"), "id").alias("m"))
    south, west = 45 - F.col("id") % 5 * 0.01, 8 - F.col("id") % 3 * 0.01
    areas = spark.range(20_000).select(F.col("id").alias("area"), south.alias("south"), west.alias("west"), (south + 0.015).alias("north"), (west + 0.015).alias("east"))
    inside = sum(i % 5 < 2 and i % 3 < 2 for i in range(20_000))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = SL.in_areas(df, areas, 0.05)
        parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 9_000 * inside and max(parts) < 0.6 * sum(parts)
        assert got.where("seq = 17").select("area").distinct().count() == inside == got.where("seq = 17").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_export_is_never_overwritten(spark, tmp_path):
    leads = lead(spark, (1, "c", "+1", "a@x.it", "http://x.it"))
    path = S.export(leads, str(tmp_path), "My Town", "cafés")
    assert spark.read.option("header", True).csv(path).columns == ["Name", "Phone", "Email", "Address", "Website Present", "Website"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        S.export(leads, str(tmp_path), "My Town", "cafés")


def test_elements_and_places(spark):
    tags = {"name": " Bar ", "website": " x.it ", "email": "0a@x.it; b@x.it1", "contact:phone": "1", "mobile": "2", "addr:street": "Via", "addr:housenumber": "1", "contact:facebook": "f"}
    rows = [("node", 1, None, None, (1.0, 2.0), tags), ("way", 2, 0.0, 5.0, (3.0, 4.0), {"brand": "B"}), ("node", 3, 1.0, 1.0, None, {"amenity": "bar"})]
    got = SL.from_elements(spark.createDataFrame(rows, "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"), "bar").orderBy("map_url").collect()
    assert [(r.name, r.lat, r.lon) for r in got] == [("Bar", 1.0, 2.0), ("B", 3.0, 5.0)]
    assert (got[0].raw_emails, got[0].raw_phones, got[0].address, got[0].socials) == (["0a@x.it", "b@x.it1"], ["1", "2"], "1 Via", {"facebook": "f"})
    assert got[0].website == "x.it"


def test_bodies_are_decoded(spark):
    rows = [(1, 200, "text/html", "latin-1", "é".encode("latin-1")), (2, 200, None, None, b"ok"), (3, 404, None, None, b"no"), (4, 200, "image/png", None, b"no"), (5, 200, "text/html", "nope", "é".encode()), (6, 200, "text/html", "utf-8", b"a\xffb")]
    got = SP.readable(ship(spark).createDataFrame(rows, "id int, status int, content_type string, charset string, body binary"))
    assert {r.id: r.html for r in got.collect()} == {1: "é", 2: "ok", 5: "é", 6: "a�b"}


def test_guesses_stop_at_the_first_address(spark):
    rows = [("u", 0, 0, []), ("u", 1, 1, ["a@x.it"]), ("u", 2, 100, ["b@x.it"]), ("v", 0, 0, []), ("v", 2, 100, ["c@x.it"]), ("v", 2, 101, ["d@x.it"])]
    got = N.pages_that_count(spark.createDataFrame(rows, "url string, kind int, ord int, emails array<string>"))
    assert sorted((r.url, r.ord) for r in got.collect()) == [("u", 0), ("u", 1), ("v", 0), ("v", 100)]


def test_planned_pages_ignore_a_last_slash(spark):
    plan = spark.createDataFrame([("h", "https://x.it/contact", 1, 1)], "url string, link string, kind int, ord int")
    fetched = spark.createDataFrame([("https://x.it/contact/", "html")], "url string, html string")
    assert N.planned_pages(plan, fetched).select("url", "html").collect() == [("h", "html")]


def test_feed_in_batches_is_the_batch(spark, tmp_path):
    leads = I.delivered(spark, SF).drop("lead_key").where("seq < 60").withColumn("name", F.concat("name", F.lit(" "), F.col("seq").cast("string")))
    leads.repartitionByRange(3, "seq").write.parquet(str(tmp_path / "in"))
    none = spark.createDataFrame([], "field string, value string")
    feed = Feed(spark, str(tmp_path / "out"), none, lambda df: df)
    stream = spark.readStream.schema(LEAD_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.seq for r in feed.run_until_full(stream, str(tmp_path / "cp")).collect()}
    merged = M.merge_leads(spark.read.parquet(str(tmp_path / "in")))
    assert got == {r.seq for r in S.accept(merged.where(S.qualifies()), None).collect()}
    assert {r.seq for r in feed.run_until_full(stream, str(tmp_path / "cp")).collect()} == got  # a re-run adds nothing
    small = Feed(spark, str(tmp_path / "out5"), none, lambda df: df, n=5)
    assert small.run_until_full(stream, str(tmp_path / "cp5")).count() == 5
    assert distinct_keys(stream.withColumn("lead_key", F.col("name"))).isStreaming
