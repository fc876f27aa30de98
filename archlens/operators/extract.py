"""Facts that texts state: imports, endpoints, client calls, models, dependencies. Each file is scanned once per kind."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.functions import dims as D
from archlens.functions.text import first, found, join_route, lookup, normalise_path, package_of, route
from archlens.sources.shared import stored

FACTS = "array<struct<kind:string,target:string>>"
JS, JVM = ["TypeScript", "JavaScript"], ["Java", "Kotlin"]


ROWS = "array<struct<framework:string,method:string,prefix:string,path:string>>"


def _row(framework: str, method: Column | str, path: Column, prefix: Column | None = None) -> Column:
    """What a rule finds, as it stands in the text; routes are made of prefix and path later, once for each row."""
    method = F.upper(method if isinstance(method, Column) else F.lit(method))
    return F.struct(F.lit(framework).alias("framework"), method.alias("method"), (F.lit("") if prefix is None else prefix).alias("prefix"), path.alias("path"))


def _each(framework: str, text: Column, pattern: str, make, groups: int = 2, keep=None, prefix: Column | None = None) -> Column:
    """Rows of a rule: make(match) -> (method, path) for each match that `keep` accepts."""
    matches = found(text, pattern, groups)
    if keep is not None:
        matches = F.filter(matches, keep)
    return F.transform(matches, lambda m: _row(framework, *make(m), prefix))


def _any_if(method: Column, *names: str) -> Column:
    return F.when(method.isin(*names), "ANY").otherwise(method)


def _in(languages: list[str] | str, rows: Column, also: Column | None = None, gate: list[str] | None = None) -> Column:
    """Rows of texts in these languages that hold one of the literals in `gate`, without which the rule can't match."""
    tests = [F.col("lang").isin(languages if isinstance(languages, list) else [languages])]
    if also is not None:
        tests.append(also)
    if gate:
        tests.append(reduce(or_, [F.contains("text", F.lit(x)) for x in gate]))
    return F.when(reduce(and_, tests), rows).otherwise(F.array().cast(ROWS))


def _exploded(files: DataFrame, rules: list[Column]) -> DataFrame:
    keep = [c for c in ("service", "module", "path") if c in files.columns]
    rows = files.select(*[F.col(c).alias("file") if c == "path" else c for c in keep], F.posexplode(F.concat(*rules)).alias("seq", "x"))
    return rows.select(*["file" if c == "path" else c for c in keep], "seq", "x.*")


def _calls(names: list[str], before: str = "", after: str = "") -> list[str]:
    return [f"{before}{n}{after}" for n in names]


VERBS = ["Get", "Post", "Put", "Patch", "Delete", "Head", "Options"]


def endpoint_rules() -> list[Column]:
    t, path = F.substring("text", 1, 512 * 1024), F.col("path")
    nest = first(t, D.NEST_CONTROLLER)
    pages = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"^.*?/pages/api/(.*)$", 1), r"\.(t|j)sx?$", ""), r"/index$", "")
    routed = F.regexp_replace(F.regexp_extract(path, r"^.*?/app/api/(.*)$", 1), r"/route\.(t|j)sx?$", "")
    prefix = F.coalesce(F.get(F.concat(F.regexp_extract_all(t, F.lit(D.FASTAPI_PREFIX), F.lit(1)), F.regexp_extract_all(t, F.lit(D.FASTAPI_INCLUDE), F.lit(1))), F.lit(0)), F.lit(""))
    spring = first(t, D.SPRING_CONTROLLER)
    is_pages = F.contains(path, F.lit("/pages/api/"))
    api = F.lit("/api/")

    def flask(m: Column) -> Column:
        named = F.filter(F.transform(F.split(m["g2"], ","), lambda s: F.regexp_replace(F.trim(s), "^['\"]+|['\"]+$", "")), lambda s: s != "")
        return F.transform(F.when(m["g2"] == "", F.array(F.lit("GET"))).otherwise(named), lambda s: _row("Flask", s, m["g1"]))

    def rails(m: Column) -> tuple[Column, Column]:
        several = m["g1"].isin("resource", "resources")
        return F.when(several, "ANY").otherwise(m["g1"]), F.when(several, F.concat(F.lit("/"), F.regexp_replace(m["g2"], "^:+|:+$", ""))).otherwise(m["g2"])

    plain = lambda m: (m["g1"], m["g2"])
    go_method = lambda m: F.when(F.upper(m["g1"]).isin("HANDLE", "HANDLEFUNC"), "ANY").otherwise(m["g1"])
    go = [*_calls(VERBS, ".", "("), *_calls([v.upper() for v in VERBS], ".", "("), ".Handle(", ".HandleFunc("]
    return [
        _in(JS, _each("NestJS", t, D.NEST_METHOD, plain, prefix=nest), gate=_calls([*VERBS, "All"], "@", "(")),
        _in(JS, _each("Express", t, D.JS_ROUTE, plain, keep=lambda m: m["g1"] != "use"), gate=_calls(["app", "router", "server", "api", "route", "fastify", "hono", "koa"], after=".")),
        _in(JS, F.array(_row("Next.js (Pages Router)", "GET", F.concat(api, pages))), is_pages),
        _in(JS, _each("Next.js (App Router)", t, D.NEXT_EXPORT, lambda m: (m["g1"], F.concat(api, routed)), 1), ~is_pages & path.rlike(r"/app/api/.+/route\.(t|j)sx?$"), ["function"]),
        _in("Python", _each("FastAPI", t, D.FASTAPI_METHOD, plain, prefix=prefix), gate=["@app.", "@router.", "@api.", "_router."]),
        _in("Python", F.flatten(F.transform(found(t, D.FLASK_ROUTE, 2), flask)), gate=[".route("]),
        _in("Python", _each("Django", t, D.DJANGO_URL, lambda m: ("ANY", m["g1"]), 1), F.endswith(path, F.lit("urls.py"))),
        _in("Ruby", _each("Rails", t, D.RAILS_ROUTE, rails), gate=["get", "post", "put", "patch", "delete", "match", "resource"]),
        _in(JVM, _each("Spring Boot", t, D.SPRING_MAPPING, lambda m: (_any_if(m["g1"], "Request"), m["g2"]), prefix=spring), gate=["Mapping"]),
        _in("PHP", _each("Laravel", t, D.LARAVEL_ROUTE, lambda m: (_any_if(m["g1"], "resource", "apiResource"), m["g2"])), gate=["Route::"]),
        _in("Go", _each("Go net/http", t, D.GO_HANDLE, lambda m: ("ANY", m["g1"]), 1), gate=["http.HandleFunc"]),
        _in("Go", _each("Go router", t, D.GO_ROUTER, lambda m: (go_method(m), m["g2"])), gate=go),
    ]


def endpoints(files: DataFrame) -> DataFrame:
    """(service, module,) file, seq, framework, method, path of every HTTP endpoint declared."""
    return _exploded(files, endpoint_rules()).withColumn("path", join_route(F.col("prefix"), F.col("path"))).drop("prefix")


def client_rules() -> list[Column]:
    t = F.substring("text", 1, 512 * 1024)
    named = lambda *anys: lambda m: (_any_if(m["g1"], *anys), m["g2"])
    fetch = lambda m: (F.when(m["g2"] == "", "GET").otherwise(m["g2"]), m["g1"])
    objects = ["this.", "Client.", "Service.", "Api.", "Http.", "Caller.", "api.", "client.", "http."]
    return [
        _in(JS, _each("axios", t, D.AXIOS, named("request")), gate=["axios."]),
        _in(JS, _each("axios", t, D.AXIOS_OBJECT, lambda m: ("ANY", m["g1"]), 1), gate=["axios"]),
        _in(JS, _each("fetch", t, D.FETCH, fetch), gate=["fetch"]),
        _in(JS, _each("ky/got", t, D.KY_GOT, named("-")), gate=["ky.", "got."]),
        _in(JS, _each("jQuery", t, D.JQUERY, named("ajax")), gate=["$."]),
        _in(JS, _each("httpClient (custom)", t, D.CLIENT_OBJECT, named("request", "send")), gate=objects),
        _in(JS, _each("local API wrapper", t, D.BARE_VERB, lambda m: (F.when(m["g1"] == "del", "DELETE").otherwise(m["g1"]), m["g2"])), t.rlike("(?mdU)" + D.BARE_IMPORT), ["import"]),
        _in("Python", _each("requests/httpx", t, D.PY_REQUESTS, named("request")), gate=["requests.", "httpx.", "client."]),
        _in("Python", _each("urllib", t, D.PY_URLOPEN, lambda m: ("GET", m["g1"]), 1), gate=["urlopen"]),
        _in("Python", _each("aiohttp", t, D.PY_AIOHTTP, named("-")), gate=["session.", "client."]),
        _in("Go", _each("net/http", t, D.GO_CLIENT, named("-")), gate=["http.", "client."]),
        _in("Ruby", _each("Net::HTTP/HTTParty/Faraday", t, D.RUBY_CLIENT, named("-")), gate=["Net::HTTP.", "HTTParty.", "Faraday."]),
        _in(JVM, _each("RestTemplate/WebClient", t, D.JAVA_CLIENT, named("-"))),
    ]


def _as_clients(rows: DataFrame) -> DataFrame:
    """Calls with their url: a path in its canonical form, any other address as it stands."""
    relative = F.startswith("path", F.lit("/"))
    url = F.when(relative, route(F.col("path"))).otherwise(F.col("path"))
    return rows.withColumns({"is_relative": relative, "path": url}).withColumnsRenamed({"framework": "client", "path": "url"})


def clients(files: DataFrame) -> DataFrame:
    """(service, module,) file, seq, client, method, url, is_relative of every HTTP call."""
    rows = _as_clients(_exploded(files, client_rules()).drop("prefix"))
    return rows.select(*[c for c in rows.columns if c != "is_relative"], "is_relative")


def http_facts(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Endpoints, client calls and global URL prefixes (service, framework, prefix) of placed files; texts are scanned once.

    Endpoints have the prefix of their service and framework in front. What texts state is stored as it stands; routes are made
    of it afterwards, so the scan's code holds the rules alone. All three are stored: what follows reads them several times, and
    routes cost more than all joins.
    """

    def tagged(role: str, rows: Column) -> Column:
        return F.transform(rows, lambda x, i: F.struct(F.lit(role).alias("role"), i.alias("seq"), *[x[c].alias(c) for c in ("framework", "method", "prefix", "path")]))

    lists = files.select("service", "module", F.col("path").alias("file"), bootstrap_place().alias("place"), F.concat(*endpoint_rules()).alias("endpoints"), F.concat(*client_rules()).alias("clients"), prefix_rows().alias("prefixes"))
    # Rules are columns of their own: inside the lists' functions that tag them, nothing of them would be compiled.
    every = F.concat(tagged("endpoint", F.col("endpoints")), tagged("client", F.col("clients")), tagged("prefix", F.col("prefixes")))
    # The place of a prefix is its bootstrap file's in the order of such files.
    found = stored(lists.select("service", "module", "file", "place", F.explode(every).alias("x")).select("service", "module", "file", "place", "x.*"))
    prefixes = stored(found.filter("role = 'prefix' and place is not null").groupBy("service", "framework").agg(F.min_by("path", "place").alias("prefix")).withColumn("prefix", route(F.col("prefix"))))
    of = prefixes.withColumnsRenamed({"service": "s", "framework": "f", "prefix": "global"})
    served = found.filter("role = 'endpoint'").withColumn("path", join_route(F.col("prefix"), F.col("path")))
    served = served.join(of, (F.col("service") == F.col("s")) & (F.col("framework") == F.col("f")), "left")
    own = ["service", "module", "file", "seq", "framework", "method"]
    served = stored(served.select(*own, F.when(F.col("global").isNull(), F.col("path")).otherwise(join_route(F.col("global"), F.col("path"))).alias("path")))
    return served, stored(_as_clients(found.filter("role = 'client'").select(*own, "path")), found), prefixes


def below(folder: str) -> Column:
    """A file's path inside the folder that a column names; the whole path if it lies elsewhere (a tree that is one service)."""
    return F.when(F.startswith("path", F.concat(folder, F.lit("/"))), F.expr(f"substring(path, length({folder}) + 2)")).otherwise(F.col("path"))


def bootstrap_place() -> Column:
    """Place of a file among the bootstrap files of its service; null for others."""
    rest = below("service")
    js = F.array_position(F.array(*[F.lit(x) for n in D.JS_BOOTSTRAPS for x in (n, f"src/{n}")]), rest)
    py = F.array_position(F.array(*[F.lit(x) for n in D.PY_BOOTSTRAPS for x in (n, f"app/{n}")]), rest)
    named = F.substring_index("path", "/", -1).isin(*D.JS_BOOTSTRAPS, *D.PY_BOOTSTRAPS)  # others are told apart by their name alone
    return F.when(named, F.when(js > 0, js).when(py > 0, py + 100))


def prefix_rows() -> Column:
    """The first global URL prefix that each framework's bootstrap states in a text, as rows of rules."""
    text = F.substring("text", 1, 64 * 1024)
    rules = [("NestJS", D.NEST_PREFIX), ("FastAPI", D.APP_PREFIX), ("Express", D.EXPRESS_PREFIX)]
    hits = F.array(*[_row(f, "", first(text, p)) for f, p in rules])
    return F.when(bootstrap_place().isNotNull(), F.filter(hits, lambda x: x["path"] != "")).otherwise(F.array().cast(ROWS))


def models(files: DataFrame) -> DataFrame:
    """service (if given), framework, model and store of data models, each once for a service."""
    t = F.substring("text", 1, 256 * 1024)
    one = lambda framework, pattern, name=lambda m: m["g1"]: _each(framework, t, pattern, lambda m: ("", name(m)), 1)
    capital = lambda m: F.concat(F.upper(F.left(m["g1"], F.lit(1))), F.lower(F.substr(m["g1"], F.lit(2))))
    rows = _exploded(files, [
        _in(JS, one("Prisma", D.PRISMA_MODEL, capital)), _in(JS, one("Mongoose", D.MONGOOSE_MODEL)),
        _in("Python", one("SQLAlchemy", D.SQLALCHEMY_CLASS)), _in("Python", one("SQLAlchemy", D.SQLALCHEMY_QUERY)),
        _in("Python", one("Django ORM", D.DJANGO_MODEL)), _in("Python", one("Django ORM", D.DJANGO_QUERY)),
        _in("Ruby", one("ActiveRecord", D.ACTIVERECORD)), _in(JVM, one("Spring Data JPA", D.JPA_ENTITY)),
        F.when(F.col("path").rlike(r"(^|/)schema\.prisma$"), one("Prisma", D.PRISMA_SCHEMA)).otherwise(F.array().cast(ROWS)),
    ])
    own = ["service"] if "service" in files.columns else []
    return rows.select(*own, "framework", F.col("path").alias("model")).distinct().withColumn("store", lookup(D.ORM_STORE, F.col("framework")))


def _import_rows(t: Column) -> Column:
    """kind and target of the import statements of a text; the target of kind go is the whole specifier."""
    lang = F.col("lang")
    row = lambda kind, target: F.struct(F.lit(kind).alias("kind"), target.alias("target"))
    python = F.transform(F.filter(found(t, D.PY_IMPORT, 3), lambda m: (m["g1"] == "") & ((m["g2"] != "") | (m["g3"] != ""))), lambda m: row("name", F.split(F.concat(m["g2"], m["g3"]), r"\.")[0]))
    here = F.regexp_extract("path", "^(.*)/[^/]*$", 1)

    def js(m: Column) -> Column:
        spec = F.concat(m["g1"], m["g2"], m["g3"], m["g4"])
        relative = spec.rlike("^[./]")
        inside = F.when(~F.startswith(spec, F.lit("/")), normalise_path(F.concat(here, F.lit("/"), spec)))  # an absolute path is none of the tree
        target = F.when(relative, inside).otherwise(package_of(spec))
        return F.struct(F.when(relative, "path").otherwise("package").alias("kind"), target.alias("target"))

    blocks = F.flatten(F.transform(F.regexp_extract_all(t, F.lit("(?mdU)" + D.GO_IMPORT_BLOCK), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit("(?U)" + D.GO_IMPORT_LINE), F.lit(1))))
    go = F.transform(F.concat(F.regexp_extract_all(t, F.lit("(?mdU)" + D.GO_IMPORT_SINGLE), F.lit(1)), blocks), lambda x: row("go", x))
    multi = F.flatten(F.transform(found(t, D.ELIXIR_MULTI_ALIAS, 2), lambda m: F.transform(F.filter(F.transform(F.split(m["g2"], ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: row("ref", F.concat(m["g1"], F.lit("."), x)))))
    refs = F.transform(F.regexp_extract_all(t, F.lit("(?mdU)" + D.ELIXIR_REF), F.lit(1)), lambda x: row("ref", F.regexp_replace(x, r"\.+$", "")))
    return F.when(lang == "Python", python).when(lang.isin(JS), F.transform(found(t, D.JS_IMPORT, 4), js)).when(lang == "Go", go).when(lang == "Elixir", F.concat(multi, refs)).otherwise(F.array().cast(FACTS))


def inner_path(specifier: Column, prefix: Column) -> Column:
    """The path of a Go specifier below the module prefix; null for other packages."""
    return F.when((specifier == prefix) | F.startswith(specifier, F.concat(prefix, F.lit("/"))), F.substr(specifier, F.length(prefix) + 2))


def imports(files: DataFrame, go_prefix: str | None = None) -> DataFrame:
    """service, module, file, seq, lang, kind and target of import statements.

    kind: name (a module's last name), path (relative, resolved), package (a bare specifier's package), inner (a Go
    path below the module prefix), ref (an Elixir module).
    """
    rows = files.filter(F.col("lang").isin(D.GRAPH_LANGUAGES)).select("service", "module", F.col("path").alias("file"), "lang", F.posexplode(_import_rows(F.col("text"))).alias("seq", "x")).select("service", "module", "file", "seq", "lang", "x.*")
    go = F.col("kind") == "go"
    target = F.when(go, inner_path(F.col("target"), F.lit(go_prefix or "\0"))).otherwise(F.col("target"))
    return rows.withColumn("target", target).withColumn("kind", F.when(go, "inner").otherwise(F.col("kind"))).filter("target is not null")


def import_statements(files: DataFrame, head: int | None = None) -> DataFrame:
    """service, module, path, loc, stated and defs of each file: what one scan of its text finds, as two lists.

    head: only so many characters of each text.

    stated: kind and target, those of `imports`, with go for whole Go specifiers, and file (each file once), gomod (the prefix
    that a service's or the root's go.mod states), pkgname (a name in a module's package.json). defs: the Elixir modules that
    are defined. path: of files that may hold a definition or a gomod; null for the others.
    """
    row = lambda kind, target: F.struct(F.lit(kind).alias("kind"), target.alias("target"))
    text, none = F.col("text") if head is None else F.substring("text", 1, head), F.array().cast(FACTS)
    elixir = F.col("lang") == "Elixir"
    defs = F.when(elixir, F.regexp_extract_all(text, F.lit("(?mdU)" + D.ELIXIR_DEFMODULE), F.lit(1))).otherwise(F.array().cast("array<string>"))
    at = lambda folder, name: F.col("path") == F.concat(folder, F.lit(f"/{name}"))
    states_go = (F.col("path") == "go.mod") | at(F.col("service"), "go.mod")
    gomod = F.when(states_go, F.array(row("gomod", first(text, D.GO_MODULE)))).otherwise(none)
    package = F.when(at(F.col("module"), "package.json"), F.array(row("pkgname", F.get_json_object("text", "$.name")))).otherwise(none)
    every = F.filter(F.concat(F.array(row("file", F.lit(""))), _import_rows(text), gomod, package), lambda x: x["target"].isNotNull())
    of = F.when(F.col("path") != "go.mod", F.col("service"))  # the root's prefix is of no service
    # In a second step: beside a new column path, the path inside the lists' functions would be that one.
    found = files.select("service", "module", "path", "loc", "lang", every.alias("stated"), defs.alias("defs"))
    return found.select(of.alias("service"), "module", F.when(elixir | states_go, F.col("path")).alias("path"), "loc", "stated", "defs")


def counted(found: DataFrame, stated: Column) -> DataFrame:
    """service, module, kind, target, path, n, loc of a list of rows that each file of `import_statements` has.

    path: of each def and gomod, as the first of these counts; null for the others, which are counted over all files. It is
    a key and no minimum, since minima of strings would sort every task's facts instead of counting them in a hash table.
    """
    rows = found.select("service", "module", "path", "loc", F.explode(stated).alias("x")).select("service", "module", "path", "loc", "x.*")
    said = rows.withColumn("path", F.when(F.col("kind").isin("def", "gomod"), F.col("path")))
    return said.groupBy("service", "module", "kind", "target", "path").agg(F.count("*").alias("n"), F.sum("loc").alias("loc"))


def import_facts(files: DataFrame) -> DataFrame:
    """service, module, kind, target, path, n, loc: what files state, and def for each Elixir module that a file defines.

    Only the beginnings of texts count here, as in a scan that reads so much of each file; no query uses this, `import_graph` reads whole texts.
    """
    defs = F.transform("defs", lambda x: F.struct(F.lit("def").alias("kind"), x.alias("target")))
    return counted(import_statements(files, 256 * 1024), F.concat("stated", defs))
