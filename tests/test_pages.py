"""Walks over page JSON, cards, detail profiles and the page source, with broken and large inputs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from carsift.sources import cards, feed, profiles, walk
from carsift.sources.dictionaries import builtin

NESTED = {"props": {"pageProps": {
    "a": {"listings": [{"id": 1, "price": 2, "related": {"id": 5, "price": 3}}, {"guid": 7, "make": "x"}, 3]},
    "searchResults": {"results": [{"id": 2, "price": 0}], "vehicles": [{"id": 3, "price": 1}]},
    "searchData": {"ads": [{"list_id": 4, "subject": "s", "attributes": []}]},
    "e": {"1": {"2": {"3": {"4": {"5": {"6": {"7": {"8": {"id": 6, "price": 9}}}}}}}}}, "d": {"description": "text"}}}}
WALKS = {"generic": [1, 5, 7, 6, 2, 3], "container": [1, 7, 6, 4, 2], "ads": [4], "listings_or_priced": [1, 7, 2, 3], "single_ad": [4]}


@pytest.mark.parametrize("finder", WALKS)
def test_finders(spark, finder):
    pages = spark.createDataFrame([(1, json.dumps(NESTED)), (2, None), (3, "[]"), (4, "{oops"), (5, '"text"')], "page_id long, text string")
    rows = walk.find(pages.withColumn("json", F.try_parse_json("text")), finder).orderBy("page_id", "path")
    got = rows.select("page_id", *[F.try_variant_get("node", f"$.{k}", "int").alias(k) for k in ("id", "guid", "list_id")]).collect()
    assert [(r.page_id, r.id or r.guid or r.list_id) for r in got] == [(1, i) for i in WALKS[finder]]


def test_first_description(spark):
    text = '{"b": [{"description": "later"}], "a": {"description": 5, "z": {"description": "first"}}}'
    pages = spark.createDataFrame([(1, text), (2, "{}")], "page_id long, text string").withColumn("json", F.try_parse_json("text"))
    assert [(r.page_id, r.d) for r in walk.first_found(pages, "detail").select("page_id", F.try_variant_get("node", "$.description", "string").alias("d")).collect()] == [(1, "first")]


def test_depth_limits(spark):
    def nested(levels):
        return '{"x":' * levels + '{"id": 1, "price": 2}' + "}" * levels

    pages = spark.createDataFrame([(n, nested(n)) for n in (9, 10, 11, 15, 16)], "page_id long, text string").withColumn("json", F.try_parse_json("text"))
    found = {f: sorted(r.page_id for r in walk.find(pages, f).collect()) for f in ("generic", "listings_or_priced")}
    assert found == {"generic": [9, 10, 11, 15], "listings_or_priced": [9, 10]}


@pytest.mark.parametrize("finder", ["generic", "container", "ads", "detail"])
def test_walks_shuffle_and_repeat_nothing(spark, finder):
    """Rounds of a recursive query were shuffled, each with all nodes of its depth."""
    pages = spark.createDataFrame([(1, json.dumps(NESTED))], "page_id long, text string").withColumn("json", F.try_parse_json("text"))
    for rows in (walk.find(pages, finder), walk.first_found(pages, finder)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "UnionLoop" not in plan and "WorkTable" not in plan
        assert plan.count("parseJson") == 1


def test_first_object_of_copies_and_of_pages_that_share_a_key(spark):
    text = lambda *values: json.dumps({f"k{i}": {"description": v} for i, v in enumerate(values)})
    pages = spark.createDataFrame([(1, text("a", "b")), (1, text("a", "b")), (None, text("c")), (2, text(3, "d")), (2, text())], "page_id long, text string")
    rows = walk.first_found(pages.withColumn("json", F.try_parse_json("text")), "detail").select("page_id", F.try_variant_get("node", "$.description", "string").alias("d"))
    assert sorted(((r.page_id or 0), r.d) for r in rows.collect()) == [(0, "c"), (1, "a"), (1, "a"), (2, "d")]


def rule(name):
    return profiles.rule(builtin("profiles")["cards"][name])


def test_ten_thousand_cards_take_linear_time():
    card = '<div class="x blocAnnonce"><a href="/a/v/ABCDEFGHIJ{}"><h2>T{}</h2></a><p>170 000 km</p><b>1 650 €</b><img src=/i></div>'

    def seconds(n):
        page, start = "<body>" + "".join(card.format(i, i) for i in range(n)) + "</body>", time.process_time()
        out = rule("paruvendu").cut(page)
        assert len(out) == n and out[-1]["parts"]["title"] == f"T{n - 1}" and out[-1]["texts"] == [f"T{n - 1}", "170 000 km", "1 650 €"]
        return time.process_time() - start

    seconds(500)
    small, large = seconds(2_500), seconds(10_000)
    assert large < 10 * small


@pytest.mark.parametrize("part", ["<div class=blocAnnonce>", "<div class='", "</div>", "<!--", "<a href=auto-occasion-annonce-1>", "<script>", "<p a=\"b>"])
def test_broken_pages_take_linear_time(part):
    start = time.process_time()
    for name in ("paruvendu", "lacentrale_links"):
        rule(name).cut("blocAnnonce auto-occasion-annonce- " + part * (60_000 // len(part)))
    assert time.process_time() - start < 30


def test_card_profiles(spark):
    html = ('<div class="annonce-item"><a href="/auto/77.htm?x" title="Du lien">x</a><p class=prix>1 650 &euro;</p><p class=info>170 000 km</p><p class=info>2009</p><p class=ville>Lyon (69)</p></div>'
            '<div class="annonce-item"><a href="/moto/78">x</a></div><div class="annonce-item">no link</div>')
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<div class='annonce-")], "page_id long, html string")
    r = profiles.card_rows(pages, "paruvendu_older", "Peugeot", "207").collect()
    assert [(x.source_listing_id, x.titre, x.prix, x.kilometrage, x.annee, x.ville, x.departement) for x in r] == [("77", "Du lien", 1650, 170000, 2009, "Lyon", "69")]


def test_details_of_sites_without_json(spark):
    html = '<div class="Description">Bon  état<script>x</script></div><img src="https://cdn/annonce/1.jpg"><img src="data:annonce"><p class="vendeur-box">Garage PRO</p>'
    pages = spark.createDataFrame([("u", html), ("v", "<p>nothing</p>"), ("w", None)], "url string, html string")
    got = {r.url: (r.description, r.images_urls, r.seller_type) for r in profiles.detail_rows(pages, "paruvendu").collect()}
    assert got == {"u": ("Bon  état", ["https://cdn/annonce/1.jpg"], "professionnel"), "v": ("", [], "")}


def test_registry(spark):
    assert feed.detail_sources() == ["autoscout24", "lacentrale", "leboncoin", "paruvendu"]
    assert feed.enabled_sources(spark) == feed.detail_sources()
    assert feed.extractors_for({"source": "AutoScout24", "marque": "Peugeot", "modele": "207"}) == [("autoscout24", {"brand": "Peugeot", "model": "207"})]
    with pytest.raises(ValueError):
        feed.extractors_for({"sources": ["elsewhere"]})


def test_batch_and_stream_give_equal_rows(spark, tmp_path):
    root = tmp_path / "pages"
    search = {"sources": ["leboncoin", "paruvendu"], "marque": "Peugeot", "modele": "207"}

    def put(source, name, rows):
        folder = root / f"source={source}"
        folder.mkdir(parents=True, exist_ok=True)
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").toPandas()
        frame.to_parquet(folder / name)

    def ad(i):
        return '<script id="__NEXT_DATA__">' + json.dumps({"props": {"pageProps": {"searchData": {"ads": [{"list_id": i, "subject": f"t{i}", "price": [i]}]}}}}) + "</script>"

    def card(i):
        return f'<div class="blocAnnonce"><a href="/a/v/ABCDEFGHIJ{i}"><h2>c{i}</h2></a><b>{900 + i} €</b></div>'

    def run():
        feed.scan_stream(spark, str(root), search, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted((r.source, r.source_listing_id, r.prix) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("leboncoin", "000.parquet", [(1, "u", ad(1)), (2, "u", None)])
    put("paruvendu", "000.parquet", [(3, "u", card(1))])
    put("elsewhere", "000.parquet", [(4, "u", "x")])
    assert run() == [("leboncoin", "1", 1), ("paruvendu", "ABCDEFGHIJ1", 901)]
    put("leboncoin", "001.parquet", [(5, "u", ad(2))])
    put("leboncoin", "002.parquet", [(6, "u", ad(3))])
    got = run()
    pages = feed.read_pages(spark, str(root))
    assert pages.count() == 6 and feed.read_pages(spark, str(root), ["paruvendu"]).count() == 1
    assert got == sorted((r.source, r.source_listing_id, r.prix) for r in feed.scan_pages(pages, search).collect())
    assert len(got) == 4 and feed.read_pages(spark, str(tmp_path / "none")).count() == 0


def test_tags_are_read_once_and_kept_within_bounds():
    from carsift.sources import cards

    rule = cards.Rule(["div.x"], {"title": ["h2"], "price": ["~price"]})
    page = lambda n: "".join(f"<div class=x><a href='/{i}'>.</a><h2>t</h2><p class=Price>{i}</p></div>" for i in range(n))
    known: dict = {}
    found = rule.cut(page(3), known)
    assert [(c["href"], c["parts"]) for c in found] == [(f"/{i}", {"title": "t", "price": str(i)}) for i in range(3)]
    assert len(known) == 6 and rule.cut(page(3), known) == found
    rule.cut(page(2 * cards.KNOWN) + f"<img src='{'y' * 1000}'>", known)
    assert len(known) <= cards.KNOWN and max(map(len, known)) <= cards.SHORT
    # unclosed quotes, comments and tags without an end, as before
    odd = "<div class=x><a href='/1>b</a><!-- <h2>no</h2> --><h2>yes</h2></div><a <!-- "
    assert rule.cut(odd, {})[0]["parts"] == {"title": "yes"}


def test_only_wanted_elements_and_columns_are_kept(spark):
    html = '<html><i>x</i><div><a href="/auto-occasion-annonce-1.html">t</a><b>1 650 €</b><img src="/i" alt="n"><img src="/j"></div><article><a href="/auto-occasion-annonce-2.html">u</a></article></html>'
    r = rule("lacentrale_links")
    page = cards.Page(html, r.selectors(), {}, r.around)
    assert len(page.attributes) == 6 and [page.near[i] for i in page.places["a"]] == [0, 4]  # two roots, two links, two images
    assert [c["texts"] for c in r.cut(html)] == [["t", "1 650 €"], ["u"]]
    assert [c["texts"] for c in cards.Rule(["div", "article"], {}, most=1).cut("<div>a</div><div>b</div>")] == [["a"]]
    pages = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    got = [x.found for x in pages.select(cards.cut(F.col("html"), r, ["src"], first_image=True).alias("found")).collect()]
    assert [[(c.text, c.parts.title, [i.asDict() for i in c.images]) for c in page] for page in got] == [
        [("t 1 650 €", None, [{"src": "/i"}]), ("u", None, [])], [], []]


def test_json_profiles_read_an_object_by_two_casts(spark):
    raw = {"id": 5, "price": {"value": "1650"}, "vehicle": {"make": "m", "mileage": "12 000 km"}, "mileage": 7, "images": ["a", {"url": "b"}, None, {"src": "c"}, "{d", 4]}
    flat = {"id": "6", "price": 3, "make": "n", "mileage": 7, "vehicle": None, "images": "no list"}
    objects = spark.createDataFrame([(json.dumps(x),) for x in (raw, flat, [1], {"id": 0})], "raw string")
    rows = profiles.json_rows(objects, "autoscout_older")
    assert rows._jdf.queryExecution().executedPlan().toString().count("variant_get(") <= 2
    got = [(r.source_listing_id, r.prix, r.marque, r.kilometrage, r.images_urls) for r in rows.orderBy("source_listing_id").collect()]
    assert got == [("5", 1650, "m", 12000, ["a", "b", "", "", "", "4"]), ("6", 3, None, None, [])]
