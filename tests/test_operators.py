"""Deduplication, order-dependent operators and the listing log against brute force on small, skewed fixtures."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from carsift.operators import dedup, ordered
from carsift.sources.extract import extract_listings
from carsift.sources.store import ListingLog

c = F.col


def _rows(n=400, seed=3):
    rnd = random.Random(seed)
    return [(i, rnd.choice("ab"), None if rnd.random() < 0.3 else str(rnd.choice([1] * 20 + list(range(40)))), f"https://x.fr/{rnd.choice([7] * 30 + list(range(60)))}?utm_source=z") for i in range(n)]


def _brute(batch, history):
    ids = {(s, i) for _, s, i, _ in history if i}
    urls = {u for *_, u in history} | {u.split("?")[0] for *_, u in history}
    out = []
    for seq, s, i, u in batch:
        if i:
            if (s, i) in ids:
                continue
            ids.add((s, i))
        k = u.split("?")[0]
        if k in urls:
            continue
        urls.add(k)
        out.append(seq)
    return out


def test_new_listings_equals_sequential_rule(spark):
    rows = _rows()
    batch, history = rows[60:], rows[:60]
    schema = "arrival_seq long, source string, source_listing_id string, url string"
    for parts in (1, 5):
        b = spark.createDataFrame(batch, schema).repartition(parts)
        got = sorted(r.arrival_seq for r in dedup.new_listings(b, spark.createDataFrame(history, schema)).collect())
        assert got == _brute(batch, history)


def test_first_wins_limits_groups_before_the_shuffle(spark):
    df = spark.createDataFrame(_rows(), "arrival_seq long, source string, source_listing_id string, url string")
    assert "WindowGroupLimit" in dedup.dedup_in_batch(df)._jdf.queryExecution().executedPlan().toString()


def test_streaks_across_buckets(spark):
    rnd = random.Random(5)
    rows = [(i, "hot" if rnd.random() < 0.7 else "b", rnd.random() < 0.8) for i in range(500)]
    want, run = {}, {}
    for i, k, f in rows:
        run[k] = run.get(k, 0) + 1 if f else 0
        want[i] = run[k]
    df = spark.createDataFrame(rows, "i long, k string, f boolean")
    got = ordered.streaks(df, "k", "i", F.floor(c("i") / 7), c("f"))
    assert {r.i: r.streak for r in got.collect()} == want


def test_lag_across_buckets(spark):
    rnd = random.Random(6)
    rows = [(i, "hot" if rnd.random() < 0.7 else "b", None if rnd.random() < 0.2 else rnd.randrange(9)) for i in range(300)]
    want, last = {}, {}
    for i, k, v in rows:
        want[i] = last.get(k)
        last[k] = v
    df = spark.createDataFrame(rows, "i long, k string, v int")
    got = ordered.lag_by_key(df, ["k"], "i", F.floor(c("i") / 11), ["v"])
    assert {r.i: r.prev_v for r in got.collect()} == want


def test_listing_log_replay_and_compaction(spark, tmp_path):
    log = ListingLog(spark, str(tmp_path / "log"))
    schema = "fingerprint string, arrival_seq long, prix int, created_at timestamp, notified boolean"
    one = spark.sql("SELECT 'a' fingerprint, 1L arrival_seq, 10 prix, timestamp'2020-01-01' created_at, true notified")
    two = spark.sql("SELECT 'a' fingerprint, 2L arrival_seq, 9 prix, timestamp'2020-01-02' created_at, false notified")
    log.append(one, 0)
    log.append(two, 1)
    log.append(two, 1)
    row = log.current().first()
    assert (row.prix, row.notified, str(row.created_at)[:10]) == (9, True, "2020-01-01")
    assert log.compact(str(tmp_path / "log2")).current().count() == 1
    assert schema


def test_cards_and_broken_pages(spark):
    html = ('<div class="blocAnnonce"><a href="/a/v/ABCDEFGHIJ12"><h2>Peugeot 207 HDi</h2></a><p>170 000 km</p><p>2009</p><b>1 650 €</b> (75)<img data-src="/x.jpg"></div>'
            '<div class="blocAnnonce"><a href="/pub/x">pub</a> 900 €</div>')
    pages = spark.createDataFrame([(1, html), (2, "<div class='blocAnnonce'"), (3, None)], "page_id long, html string")
    rows = extract_listings(pages, "paruvendu").collect()
    assert [(r.source_listing_id, r.prix, r.kilometrage, r.annee, r.departement, r.thumbnail_url) for r in rows] == [("ABCDEFGHIJ12", 1650, 170000, 2009, "75", "/x.jpg")]


def test_json_profiles(spark):
    auto = '<script id="__NEXT_DATA__">{"p":{"listings":[{"id":"L1","price":{"priceFormatted":"€ 2 200"},"vehicle":{"make":"Peugeot","mileageInKm":"130 000 km","firstRegistration":"05/2011"},"location":{"zip":"75001"}},{"title":"sans id"}]}}</script>'
    bad = '<script id="__NEXT_DATA__">{oops</script>'
    pages = spark.createDataFrame([(1, auto), (2, bad)], "page_id long, html string")
    r = extract_listings(pages, "autoscout24").collect()
    assert [(x.source_listing_id, x.prix, x.kilometrage, x.annee, x.departement) for x in r] == [("L1", 2200, 130000, 2011, "75")]
    cen = '<script>window.__INITIAL_STATE__ = {"results":[{"id":7,"price":"1 800 €","vehicle":{"make":"Renault","mileage":{"value":90000},"year":2010},"location":{"zipCode":"94000"}}]};</script>'
    r = extract_listings(spark.createDataFrame([(1, cen)], "page_id long, html string"), "lacentrale").collect()
    assert [(x.source_listing_id, x.prix, x.kilometrage, x.annee, x.departement) for x in r] == [("7", 1800, 90000, 2010, "94")]


def test_near_duplicate_finds_the_stored_row_itself(spark):
    schema = "arrival_seq long, fingerprint string, fingerprint_soft string, created_at timestamp, prix int, score_total int, notified boolean"
    at = lambda h: datetime(2024, 1, 1, h)
    hist = spark.createDataFrame([(1, "f1", "s1", at(1), 10, 50, True), (2, "f2", "s1", at(2), 11, 51, False), (3, "f3", "", at(3), 1, 1, True)], schema)
    batch = spark.createDataFrame([(10, "f2", "s1", at(5), 9, 50, False), (11, "f9", "s9", at(5), 9, 50, False), (12, "f3", "", at(5), 9, 50, False)], schema)
    got = {r.arrival_seq: r.near and r.near.fingerprint for r in dedup.near_duplicates(batch, hist).collect()}
    assert got == {10: "f2", 11: None, 12: None}


def test_price_log_adds_and_retracts(spark, tmp_path):
    from carsift.operators.market import PriceLog, price_counts, price_stats

    schema = "vehicule_cible_id string, annee int, kilometrage int, departement string, prix int, id int"
    rnd, state = random.Random(8), {}
    log, other = PriceLog(spark, str(tmp_path / "log")), None
    for batch in range(4):
        now, before = [], []
        for _ in range(12):
            i = rnd.randrange(15)
            row = (rnd.choice(["a", "b", ""]), rnd.choice([2009, 2010, None]), rnd.choice([90_000, 120_000]), rnd.choice(["75", "", None]), rnd.choice([900, 1000, None]), i)
            before += [state[i]] if i in state else []
            state[i] = row
            now.append(row)
        now, before = (spark.createDataFrame(x, schema) for x in (now, before))
        log.apply(now, before, batch)
        if batch == 2:
            log.apply(now, before, batch)  # a replay
            other = log.compact(str(tmp_path / "compact"), batch)
        elif other:
            other.apply(now, before, batch)
    want = {tuple(r) for r in price_stats(price_counts(spark.createDataFrame(list(state.values()), schema))).collect()}
    assert {tuple(r) for r in log.prices().collect()} == want == {tuple(r) for r in other.prices().collect()} and want


def test_dictionary_target_of_listings_that_share_a_key(spark):
    from carsift.operators.identify import with_target, with_target_by_dictionary
    from carsift.sources import dictionaries as dic

    rows = [(7, "Peugeot", "207", "1.4 HDi 70ch", "Peugeot 207 1.4 HDi 70ch", "diesel"), (7, "Ford", "Focus", "x", "Ford Focus x", "essence"),
            (None, "Peugeot", "207", "1.4 HDi 70ch", "Peugeot 207 1.4 HDi 70ch", "diesel"), (8, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "arrival_seq long, marque string, modele string, version string, titre string, carburant string")
    got = with_target_by_dictionary(df, dic.dim_vehicle(spark), dic.dim_vehicle_pattern(spark), dic.dim_vehicle_exclusion(spark))
    order = lambda d: sorted(map(str, d.select("arrival_seq", "marque", "vehicule_cible_id").collect()))
    assert order(got) == order(with_target(df)) and got.filter("vehicule_cible_id <> ''").count() == 2


def test_details_that_share_an_address_merge_once(spark):
    from carsift.operators.merge import merge_detail

    extra = "description string, images_urls array<string>, seller_type string, seller_name string, seller_phone string, carburant string, boite string, puissance_ch int, version string, motorisation string"
    plain = ("d", [], "unknown", "", "", "unknown", "unknown", None, "", "")
    listings = spark.createDataFrame([("a", *plain), ("a", *plain), ("b", *plain), (None, *plain)], "url string, " + extra)
    details = [(u, f"detail {i}", ["x"], "", "", "", "", "", None, "v", "") for u, i in (("a", 1), ("a", 2), (None, 3), (None, 4))]
    results = [sorted((r.url or "", r.description) for r in merge_detail(listings, spark.createDataFrame(some, "url string, " + extra)).collect())
               for some in (details, details[::-1])]
    assert results[0] == results[1] and [u for u, _ in results[0]] == ["", "a", "a", "b"]
    assert results[0][0][1] == "d" and len({d for u, d in results[0] if u == "a"}) == 1 and results[0][3] == ("b", "d")


def test_reading_a_table_limits_generated_methods(spark, tmp_path):
    from carsift.sources.listings import read_table

    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.range(1).write.parquet(str(tmp_path / "part.parquet"))
    try:
        for given, then in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(name, given)
            read_table(spark, str(tmp_path), "part")
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)
