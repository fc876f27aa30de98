import random
import re

import pytest
from pyspark.sql import functions as F

from archlens.functions import dims
from archlens.functions.text import route
from archlens.operators import enrich, report
from archlens.operators.discover import place
from archlens.operators.rank import ranked
from archlens.operators.resolve import http, resolve_clients
from archlens.sources.tree import typed


def plain(url, endpoints, prefixes):
    """The endpoint that a url reaches, tried with every prefix in front."""
    tried = [("", url)] + [(p, p + url) for p in sorted(prefixes) if url != p and not url.startswith(p + "/")]
    best = None
    for p, candidate in tried:
        for e in endpoints:
            if e == "/":
                score = 101 if candidate == "/" else None
            else:
                score = len(e) + 100 if e == candidate else len(e) if candidate.startswith(e + "/") else None
            if score is not None and (best is None or score > best[0] or score == best[0] and p < best[1]):
                best = (score, p, e)
    return best and best[2]


@pytest.mark.parametrize("seed", range(3))
def test_calls_reach_what_trying_all_prefixes_reaches(spark, seed):
    rng = random.Random(seed)
    path = lambda low, high: "/" + "/".join(rng.choice(["a", "b", "ab", ":id", "v1"]) for _ in range(rng.randint(low, high)))
    prefixes = sorted({path(1, 3) for _ in range(rng.choice([0, 3, 9]))})
    endpoints = sorted({path(1, 4) for _ in range(25)} | {"/"} | {p + path(1, 2) for p in prefixes} | set(prefixes[:2]))
    urls = sorted({path(1, 4) for _ in range(80)} | {"/"} | {p + path(1, 2) for p in prefixes} | set(prefixes))
    served = spark.createDataFrame([("s", "m", "GET", "f", k, e) for k, e in enumerate(endpoints)], "service string, module string, method string, file string, seq int, path string")
    calls = spark.createDataFrame([(u, True) for u in urls], "url string, is_relative boolean")
    got = {r.url: r.endpoint_path for r in resolve_clients(calls, served, prefixes).collect()}
    assert got == {u: plain(u, endpoints, prefixes) for u in urls}


def test_code_of_the_rules_compiles(spark):
    rows = [
        ("a/src/m/x.ts", "app.get('/x/{id}', h)\n@Controller('c')\n@Get(':id') b() {}\n"), ("a/src/main.ts", "app.setGlobalPrefix('v1')\n"), ("b/src/m/y.ts", "axios.get('/py/3')\nfetch('/x/1')\n"),
        ("a/src/m/z.py", "@app.get('/py')\n@bp.route('/f', methods=['GET', 'PUT'])\n"), ("a/src/m/w.rb", "  get '/r'\n"), ("a/src/m/v.go", 'r.Get("/g", h)\n'), ("a/src/m/u.java", '@GetMapping("/j")\n'),
    ]
    files = typed(spark.createDataFrame(rows, "path string, text string"))
    spark.conf.set("spark.sql.codegen.fallback", "false")  # code that doesn't compile is an error then
    try:
        found = http(place(files))
        assert {(r.source_service, r.target_service, r.path, r.weight) for r in found.edges().collect()} == {("b", "a", "/py", 1)}
        assert {r.path for r in found.served.collect()} == {"/x/:id", "/v1/c/:id", "/py", "/f", "/r", "/g", "/j"}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_terms_like_a_search_for_each(spark):
    rng = random.Random(3)
    pieces = ["a", "b", "A", "++", "-", ".", " ", "C", "é", "1", "İ", "\n"]
    aliases = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 3))).strip() for _ in range(60)} - {""})
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(20)]
    terms = [(f"t{k}", f"d{k}", a, k % 2 == 0) for k, a in enumerate(aliases)]

    def has(text, alias, exact):
        text, alias = (text, alias) if exact else (text.lower(), alias.lower())
        return re.search(rf"(?<![A-Za-z0-9]){re.escape(alias)}(?![A-Za-z0-9])", text) is not None

    want = {(n, d) for n, d, a, e in terms if any(has(t, a, e) for t in texts)}
    corpus = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    table = spark.createDataFrame(terms, "name string, definition string, alias string, case_sensitive boolean")
    for block in (7, 1000):
        assert {tuple(r) for r in enrich.terms_found(corpus, table, block).collect()} == want
    assert enrich.terms_found(corpus, table.limit(0)).isEmpty() and enrich.terms_found(corpus.limit(0), table).isEmpty()


def test_places_in_a_global_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 613).alias("k"), F.col("id"))
    got = ranked(rows, F.desc("k"), F.asc("id"), name="place", start=0)
    want = sorted(((-(i * 7919 % 613), i) for i in range(5000)))
    assert [(r.id, r.place) for r in got.orderBy("place").collect()] == [(i, n) for n, (_, i) in enumerate(want)]
    assert ranked(rows.limit(0), F.asc("k")).isEmpty()
    plan = ranked(rows, F.asc("k"), F.asc("id"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_shares_are_zero_without_lines(spark):
    files = spark.createDataFrame([("a", "Python", 0), ("b", "Python", 0)], "service string, lang string, loc long")
    assert [r.share for r in report.services(files).collect()] == [0.0, 0.0]


def test_routes_are_made_once_and_calls_of_no_endpoint_are_no_key_of_a_join(spark):
    rows = [("a/src/main.ts", "app.setGlobalPrefix('p/v1')\n"), ("a/src/m/x.ts", "@Controller('c')\nclass C {\n @Get(':id') b() {}\n @Get() c() {}\n}\n"), ("c/src/m/x.ts", "app.get('/api', h)\napp.get('/p/v1', h)\n"),
            ("b/src/m/y.ts", "axios.get('/c/3')\naxios.get('/c')\naxios.get('/p/v1/c/4')\naxios.get('/api/5')\naxios.get('/p/v1')\naxios.get('/none')\n")]
    found = http(place(typed(spark.createDataFrame(rows, "path string, text string"))))
    plan = found.edges()._jdf.queryExecution().sparkPlan().toString()
    assert "(?U)" not in plan and not [x for x in plan.splitlines() if "Join" in x and "endpoint_path" in x]
    # /c/3 begins with an endpoint as it stands behind the prefix; an endpoint that is a bare prefix or /api is none.
    want = {"/c/3": "/p/v1/c", "/c": "/p/v1/c", "/p/v1/c/4": "/p/v1/c", "/api/5": None, "/p/v1": None, "/none": None}
    assert {r.url: r.endpoint_path for r in found.resolved.collect()} == want
    assert {tuple(r) for r in found.edges().collect()} == {("b", "a", "GET", "/p/v1/c", 3)}


def test_plain_routes_are_what_all_steps_leave(spark):
    """A path before the canonical form, put together of pieces; those that count as plain are left as they are."""
    rng = random.Random(5)
    pieces = ["/", "//", "a", "B9", ":id", "{x}", "<int:a>", "[s]", "(x:y)", "${q}", "$:w", " ", "\n", "é", "-", ".", "%20", "@", "="]
    paths = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(0, 7))) for _ in range(4000)} | {"/a/b", "/a\n", "/a/", ""} | {"".join("/" + "".join(rng.choices("aZ9_.~%+,;=@-", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 4))) for _ in range(100)})

    def plain_route(p):
        p = p.strip(" ")
        p = re.sub("/+(?=\n?\\Z)", "", p if p.startswith("/") else "/" + p)
        for pattern in dims.ROUTE_PARAMETERS:
            p = re.sub(pattern, ":id", p)
        return re.sub("/+", "/", p) or "/"

    got = {r.p: (r.r, r.plain) for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", route(F.col("p")).alias("r"), F.col("p").rlike(dims.PLAIN_ROUTE).alias("plain")).collect()}
    assert {p: r for p, (r, _) in got.items()} == {p: plain_route(p) for p in paths}
    assert all(p == plain_route(p) for p, (_, plain) in got.items() if plain) and 30 < sum(plain for _, plain in got.values()) < len(paths)
