"""Links between pages: their forms, and blocks spread over a generated graph."""

import posixpath
import random

import duckdb
import pytest

import plain_text as plain
from warpwise.llm import queries, url_filter

FORMS = [
    ('<link rel="canonical" href="/a;v=2/b;c">', "/a;v=2/b;c"),
    ("<link href='/a b' rel='alternate canonical'>", "/a b"),
    ("<LINK REL = Canonical HREF = /x?y>", "/x"),
    ('<link rel="canonical" href="../up">', "/dir/up"),
    ('<link rel="canonical" href="../../../../top/./x/..">', "/top/"),
    ('<link rel="canonical" href="./same">', "/dir/sub/same"),
    ('<link rel="canonical" href=" next ">', "/dir/sub/next"),
    ('<link\nrel="canonical"\nhref="/line">', "/line"),
    ('<meta http-equiv="refresh" content="5; URL=\'/r;s=1?q\'">', "/r;s=1"),
    ('<meta http-equiv=refresh content="0;url=//Site.org/z/../w">', "/w"),
    ('<link rel="canonical" href="?page=2">', None),
    ('<link rel="canonical" href="mailto:a@b.net">', None),
    ('<link rel="canonicals" href="/no">', None),
    ('<link data-rel="canonical" rel="icon" href="/no">', None),
    ('<meta http-equiv="refresh" content="30">', None),
    ('<meta name="refresh" content="0; url=/no">', None),
]


def judged_by_sql(spark, folder, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return sorted(con.execute(queries.OP6_SQL).fetchall(), key=repr)


def test_forms_of_links(spark, tmp_path):
    pages = spark.createDataFrame([(f"p{i}", "/dir/sub/page", html) for i, (html, _) in enumerate(FORMS)], "host string, path string, html string")
    found = {r["host"]: (r["to_host"], r["to_path"]) for r in url_filter.alias_links(pages).collect()}
    assert {k: v for k, v in found.items()} == {f"p{i}": ("site.org" if "Site" in html else f"p{i}", to) for i, (html, to) in enumerate(FORMS) if to}
    # targets that a rule blocks spread to the page, in code and in SQL
    rows = [(i, f"http://p{i}.org/dir/sub/page", html) for i, (html, _) in enumerate(FORMS)]
    rows += [(100 + i, f"http://p{i}.org{to}", '<link rel=canonical href="http://x.net/es/">') for i, (html, to) in enumerate(FORMS) if to and "Site" not in html]
    wanted = judged_by_sql(spark, str(tmp_path), rows)
    got = sorted(map(tuple, queries.op6_url_filter(spark, str(tmp_path)).collect()), key=repr)
    assert got == wanted and {r[0]: r[4] for r in got if r[0] < 100} == {i: "block" if to and "Site" not in html else "allow" for i, (html, to) in enumerate(FORMS)}


def styled(rng, path, target_host, target_path, host):
    """A tag that names the target in one of several ways."""
    address = f"http://{target_host}{target_path}"
    if target_host == host and rng.random() < 0.5:
        address = posixpath.relpath(target_path, posixpath.dirname(path)) if rng.random() < 0.5 else target_path
    quote = rng.choice("\"'")
    if rng.random() < 0.3:
        return f"<meta http-equiv={quote}Refresh{quote} content={quote}{rng.randrange(9)}; url={address}{quote}>"
    return f"<link rel={quote}{rng.choice(['canonical', 'alternate canonical', 'CANONICAL next'])}{quote} href={quote}{address}{quote}>"


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_spread_over_a_graph(spark, tmp_path, seed):
    """Chains, cycles and a hub of thousands of pages against union-find."""
    rng = random.Random(seed)
    n = 3000
    where = [(f"h{rng.randrange(40)}.{rng.choice(['org', 'com', 'info'])}", f"/d{rng.randrange(5)}/e;{rng.randrange(5)}/p{i}") for i in range(n)]
    for i in rng.sample(range(n), 12):
        where[i] = (f"b{i}.net", f"/{rng.choice(['es', 'fr'])}/p{i}")
    links = [(i, i + 1) for i in range(0, 700) if i % 70]  # chains
    links += [(i, 700 + (i - 699) % 50) for i in range(700, 750)]  # a cycle
    links += [(i, 800) for i in range(801, 1800)]  # a hub
    links += [(rng.randrange(1800, n), rng.randrange(1800, n)) for _ in range(500)]
    html = {i: "<html>" for i in range(n)}
    for i, j in links:
        if i != j:
            html[i] += styled(rng, where[i][1], *where[j], where[i][0])
    rows = [(i, f"https://{h}{p}?x={i}", html[i]) for i, (h, p) in enumerate(where)]
    root = plain.components(range(n), [(i, j) for i, j in links if i != j])

    def rule(host, path):
        if host.endswith(".com"):
            return "com/", "allow"
        return next(((f"net/{c}/", "block") for c in ("es", "fr") if host.endswith(".net") and path.startswith(f"/{c}/")), (None, None))

    shut = {root[i] for i, w in enumerate(where) if rule(*w)[1] == "block"}
    wanted = [(i, *w, rule(*w)[0], rule(*w)[1] or ("block" if root[i] in shut else "allow")) for i, w in enumerate(where)]
    by_sql = judged_by_sql(spark, str(tmp_path), rows) if seed == 1 else sorted(wanted, key=repr)
    got = sorted(map(tuple, queries.op6_url_filter(spark, str(tmp_path)).collect()), key=repr) if seed == 1 else None
    if got is None:
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
        got = sorted(map(tuple, url_filter.judged(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    assert got == sorted(wanted, key=repr) == by_sql
    assert sum(r[4] == "block" for r in got) > 50
