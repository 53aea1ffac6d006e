import gzip
import random
import zlib

from tabsmith.llm import url_rules, warc
from tabsmith.llm.html_blocks import leaves

URLS = "page_id long, url string, html string, host string, path string, verdict string"


def plain_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    best = None
    for h, p, v in rules:
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), v == "block")
            if best is None or key > best[0]:
                best = (key, h + p, v)
    return host, path, best and best[1], best[2] if best else "allow"


def test_judge_against_all_rules(spark):
    rng = random.Random(7)
    labels, parts = ["a", "b", "cc", "net", "x-y"], ["", "/", "/p", "/p/", "/p/q", "/pq"]
    rules = {(".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(parts)): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [("", "/p/q", "block"), ("net", "/", "allow"), ("net", "/", "block")]
    urls = [None, "", "net", "://", "http://", "HTTP://A.NET", "http://net?x=/p", "http://a.b\x01net/p", "http://..net//"]
    urls += [f"http://{'.'.join(rng.choices([*labels, 'W'], k=rng.randint(1, 5)))}{rng.choice(parts)}{rng.choice(['', 'z', '/z', '?a', '#b'])}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "", "h", "p", "v") for i, u in enumerate(urls)], URLS)
    rdf = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    for n in (1, 5):
        got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge(df, rdf, parts=n).collect()}
        assert got == {i: plain_judge(u, rules) for i, u in enumerate(urls)}


def test_judge_hot_host_and_empty(spark):
    rows = [(i, f"http://hot.example.net/{i}", "", "", "", "") for i in range(400)] + [(1, "http://hot.example.net/1", "", "", "", "")]
    df = spark.createDataFrame(rows, URLS)
    rules = spark.createDataFrame([("example.net", "/1", "block")], "host string, path string, verdict string")
    got = url_rules.judge(df, rules, parts=8).collect()
    assert len(got) == 401 and sum(r["verdict"] == "block" for r in got) == sum(str(r[0]).startswith("1") for r in rows)
    assert url_rules.judge(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge(df, rules.limit(0)).collect()} == {"allow"}


def test_leaves():
    html = "<html><body><!-- x --><nav><a href='/a'>Menu</a></nav><p class=lead>One &amp; <b>two<br>three<p>four&nbsp;\n five</div><script>var p='<p>';</script><ul><li>x<li>y</ul>tail &#233"
    got = [(x.path[-1], x.text) for x in leaves(html)]
    assert got == [("nav", "Menu"), (".lead", "One & two three"), ("p", "four five"), ("li", "x"), ("li", "y"), ("body", "tail é")]
    assert leaves(None) == [] and leaves("") == [] and [x.text for x in leaves("plain < text")] == ["plain < text"]
    assert leaves("<p" * 5000) == [] and len(leaves("<div>" * 3000 + "deep")) == 1


def test_derive_links_records(spark):
    html = "<html lang='fr'><head><title>T&eacute;</title></head><body><p>Bonjour<a href='/x'>ici</a></p></body></html>"
    pages = spark.createDataFrame([(1, "http://e.org/é", html, "", "", ""), (2, None, None, "", "", ""), (2, None, None, "", "", "")], URLS)
    src = warc.responses(pages)
    by = {r["page_id"]: r for r in src.collect()}
    made = warc.derive(src, carry=("page_id",)).collect()
    assert len(made) == 6
    head = warc.parse_header(by[1]["header"])
    meta, text = (next(r for r in made if r["page_id"] == 1 and r["record_type"] == k) for k in ("metadata", "conversion"))
    assert meta["refers_to"] == text["refers_to"] == head["warc-record-id"] and text["target_uri"] == "http://e.org/é"
    assert text["block"] == "Bonjourici" and text["source_payload_digest"] == head["warc-payload-digest"]
    info = warc.parse_header(meta["block"])
    assert info["title"] == "Té" and info["language"] == "fr" and info["outlink"] == "/x" and info["status"] == "HTTP/1.1 200 OK"
    assert info["source-block-digest"] == head["warc-block-digest"] == warc.digest(bytes(by[1]["block"]))
    assert text["block_digest"] == warc.digest(text["block"].encode()) and meta["record_id"] != text["record_id"]
    assert warc.derive(src.limit(0)).count() == 0


def test_derive_odd_records():
    assert warc.derive_one("WARC-Type: request\r\n", b"") == [] and warc.derive_one(None, None) == []
    bare = warc.derive_one("WARC-Type: response\r\n", b"just text")
    assert [r["block"] for r in bare][1] == "just text" and bare[0]["date"] == warc.EPOCH
    latin = warc.derive_one("WARC-Type: response\r\nWARC-Record-ID: <a>\r\n", b"HTTP/1.1 404 No\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>\xe9")
    assert latin[1]["block"] == "é" and latin[1]["refers_to"] == "<a>" and "status: HTTP/1.1 404 No" in latin[0]["block"]


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://e.org/{i}", f"<p>text {i}</p><p>\r\n\r\nmore é</p>", "", "", "") for i in range(20)], URLS)
    made = warc.derive(warc.responses(pages)).select("header", "block")
    warc.write_warc(made, str(tmp_path / "w"))
    back = sorted((r["header"], bytes(r["block"]).decode()) for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    assert back == sorted((r["header"], r["block"]) for r in made.collect())


# ---------------------------------------------------------------- pages and archives as they are found

def texts(html):
    return [x.text for x in leaves(html)]


def test_comments_and_nested_elements():
    for tag in ("<!-->", "<!--->", "<!-- x --!>", "<!-- x -->", "<!-- <p>no</p> -- > still -->", "<svg title='a>b' />", "<svg title='a>b'><g/></svg>",
                "<svg><svg x/><svg>no</svg>no</svg>", "<template><template><p>no</p></template><p>no</p></template>",
                "<template a='>'><!-- </template> --><p>no</p></template>", "<iframe src='x'><p>no</p></iframe>",
                "<textarea><p>no</p></textarea >", "<script a='>'>if (a < b) '</p>'</script\n>", "<STYLE>no</style>"):
        assert texts(f"<p>a</p>{tag}<p>rest</p>") == ["a", "rest"], tag
    for tag in ("<template>", "<svg>", "<!-- x", "<script>"):           # never closed: to the end of the page
        assert texts(f"<p>a</p>{tag}<p>no</p>") == ["a"], tag


def archive(records, version="WARC/1.0", end=b"\r\n\r\n"):
    """Bytes of records (fields, block), written by hand."""
    out = []
    for fields, block in records:
        head = "".join(f"{k}: {v}\r\n" for k, v in fields)
        out.append(f"{version}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + end)
    return out


def test_archives_as_bytes(spark, tmp_path):
    latin = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>caf\xe9 \xfc</p>"
    tricky = b"HTTP/1.1 200 OK\r\n\r\n<p>a</p>\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n<p>b</p>"
    rows = [([("WARC-Type", "response"), ("WARC-Record-ID", f"<r{i}>"), ("WARC-Target-URI", f"http://e.org/{i}")], b)
            for i, b in enumerate((latin, tricky, bytes(range(256)), b""))]
    want = sorted((f"<r{i}>", b) for i, (_, b) in enumerate(rows))
    for name, data in (("plain10.warc", b"".join(archive(rows))), ("plain11.warc", b"".join(archive(rows, "WARC/1.1"))),
                       ("members.warc.gz", b"".join(gzip.compress(r) for r in archive(rows))), ("whole.warc.gz", gzip.compress(b"".join(archive(rows)))),
                       ("damaged.warc", b"rubbish\r\n" + b"".join(archive(rows))), ("cut.warc.gz", b"".join(gzip.compress(r) for r in archive(rows)) + gzip.compress(b"x" * 99)[:20])):
        path = tmp_path / name
        path.write_bytes(data)
        got = sorted((warc.parse_header(r["header"])["warc-record-id"], bytes(r["block"])) for r in warc.read_warc(spark, str(path)).collect())
        assert got == want, name
    conv = {r["refers_to"]: r["block"] for r in warc.derive(warc.read_warc(spark, str(tmp_path / "plain10.warc"))).filter("record_type = 'conversion'").collect()}
    assert conv["<r0>"] == "café ü" and conv["<r3>"] == ""
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.warc").write_bytes(b"")
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_encoded_payloads():
    page = "<p>grün</p><p>zwei</p>".encode()
    chunks = b"5\r\n" + page[:5] + b"\r\n" + f"{len(page) - 5:x};ext=1\r\n".encode() + page[5:] + b"\r\n0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    deflated = raw.compress(page) + raw.flush()
    for fields, payload in (("Transfer-Encoding: chunked", chunks), ("Content-Encoding: gzip", gzip.compress(page)), ("Content-Encoding: deflate", zlib.compress(page)),
                            ("Content-Encoding: deflate", deflated), ("Content-Encoding: identity", page)):
        block = f"HTTP/1.1 200 OK\r\n{fields}\r\n\r\n".encode() + payload
        meta, text = warc.derive_one("WARC-Type: response\r\nWARC-Record-ID: <x>\r\n", block)
        assert text["block"] == "grün\nzwei", fields
        assert warc.parse_header(meta["block"])["source-payload-digest"] == warc.digest(payload)
    both = gzip.compress(page)
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + f"{len(both):x}\r\n".encode() + both + b"\r\n0\r\n\r\n"
    assert warc.derive_one("WARC-Type: response\r\n", block)[1]["block"] == "grün\nzwei"
    broken = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n<p>plain after all</p>"
    assert warc.derive_one("WARC-Type: response\r\n", broken)[1]["block"] == "plain after all"
