"""XPath bodies against a search in a tree, XML with and without faults against the standard parser."""

import io
import random
import tracemalloc
import zipfile
from xml.etree import ElementTree

import pytest

from priorlens.sources import markup, xml, xpath


def page(r, depth=0):
    out = ""
    for _ in range(r.randint(1, 4)):
        tag = r.choice(["div", "section", "span", "article"])
        attrs = "".join(f' {k}="{r.choice(["x", "y", "x y"])}"' for k in ("class", "id") if r.random() < 0.4)
        out += f"<{tag}{attrs}>{page(r, depth + 1) if depth < 4 and r.random() < 0.7 else 'text'}</{tag}>"
    return out


PATHS = ["//div", "/html/body/div", "//div[@id='x']", "//section[2]", "//div[@class='x']/span", "//*[@id]", "//div//span[1]", "/html/body/*[3]", "//article[contains(@class, 'y')]", "//div[@class='x'][2]", "//*[contains(@id,\"x\")]/div", "//body//div/div", "/html/body/div[1]/section[@class]"]


def searched(root, path):
    """The same paths in a tree: steps by going over all nodes."""

    def below(n):
        for c in n:
            yield c
            yield from below(c)

    now = [ROOT(root)]
    for descendant, name, predicates in xpath.compiled(path):
        found = []
        for parent in [p for n in now for p in ([n, *below(n)] if descendant else [n])]:
            some = [c for c in parent if name in ("*", c.tag)]
            for p in predicates:
                if isinstance(p, int):
                    some = some[p - 1 : p]
                else:
                    some = [c for c in some if c.get(p[0]) is not None and (p[1] is None or c.get(p[0]) == p[1]) and (p[2] is None or p[2] in c.get(p[0]))]
            found += some
        now = list(dict.fromkeys(found))
    return now


class ROOT(list):
    def __init__(self, root):
        super().__init__([root])

    def __hash__(self):
        return 1


def test_paths_against_a_tree():
    r, hits = random.Random(2), 0
    for _ in range(150):
        html = f"<html><body>{page(r)}</body></html>"
        root = ElementTree.fromstring(html)
        paths = {}

        def name(n, at):
            paths[n] = at
            seen = {}
            for c in n:
                seen[c.tag] = seen.get(c.tag, 0) + 1
                name(c, f"{at}/{c.tag}[{seen[c.tag]}]")

        name(root, "/html[1]")
        for p in PATHS:
            got = xpath.select(html, p)[0]
            assert sorted(got) == sorted(paths[n] for n in searched(root, p)), (p, html)
            hits += len(got)
    assert hits > 3000
    for bad in ("", "div", "//div[last()]", "//div[@a=x]", "//div/text()"):
        with pytest.raises(ValueError):
            xpath.compiled(bad)


def test_chosen_bodies(spark):
    html = "<html><body><div id='b'><h1>Head</h1><p>One  two</p><script>x</script><p hidden>no</p></div><div class='c'><p>Other</p></div></body></html>"
    rows = [(1, html, "//div[@id='b']"), (2, html, "//div"), (3, html, None), (4, html, "//p/text()"), (5, None, "//div"), (6, None, None), (7, html, "//div[@class='none']"), (8, "<p></p>", "//p"), (9, html, "")]
    got = {x.page_id: x for x in xpath.chosen_bodies(spark.createDataFrame(rows, "page_id long, html string, body_xpath string")).collect()}
    assert got[1].status == "selected" and got[1].body == "Head\nOne two" and [(b.start, b.end) for b in got[1].blocks] == [(0, 4), (5, 12)] and all(got[1].body[b.start : b.end] == b.text for b in got[1].blocks)
    one = "body_xpath_must_select_one_element"
    assert [got[i].status for i in range(2, 10)] == [one, "fallback", "unsupported_xpath", one, "no_text_extracted", one, "no_text_extracted", "fallback"]
    assert got[3].location_status == "text_only_unlocated" and "Other" in got[3].body and got[3].blocks == []


def test_spans_of_any_size():
    """No cap on spans, and no memory for them."""
    cells = lambda html: [(b["row_index"], b["col_index"], b["rowspan"], b["colspan"]) for b in markup.walk(html).blocks if b["block_type"] == "cell"]
    assert cells("<table><tr><td rowspan=50000 colspan=3000>a<td>b<tr><td>c</table>") == [(0, 0, 50000, 3000), (0, 3000, 1, 1), (1, 3000, 1, 1)]
    assert cells("<table><tr><td rowspan=2>a<td>b<td rowspan=3>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>") == [(0, 0, 2, 1), (0, 1, 1, 1), (0, 2, 3, 1), (1, 1, 1, 1), (1, 3, 1, 1), (2, 0, 1, 1), (2, 1, 1, 1), (2, 3, 1, 1)]
    assert cells("<table><tr><td rowspan=999999999999 colspan=999999999999>a<td>b</table>")[1][1] == markup.MOST


def zipped(path, entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(name, text)


def read(data, chunk):
    reader = xml.Reader()
    for i in range(0, len(data), chunk):
        reader.feed(data[i : i + chunk])
    reader.close()
    return reader


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_well_formed_xml(chunk):
    text = '<?xml version="1.0"?><!DOCTYPE a><a x="1 &lt; 2"><!-- <b>no</b> --><b>één &amp; two</b><b><c/>t1<c k=\'v\'/>t2</b><d><![CDATA[<raw> & ]]></d>\n<e>&#44032;</e></a>'
    reader = read(text.encode(), chunk)
    paths = {}

    def name(n, at):
        seen = {}
        for c in n:
            seen[c.tag] = seen.get(c.tag, 0) + 1
            name(c, f"{at}/{c.tag}[{seen[c.tag]}]")
        own = (n.text or "") + "".join(c.tail or "" for c in n)
        if own.strip() or n.attrib:
            paths[at] = (n.tag, n.attrib, own.strip())

    name(ElementTree.fromstring(text), "/a[1]")
    assert {p: (t, a, x.strip()) for p, t, a, x in reader.done} == paths and reader.faults == 0


@pytest.mark.parametrize("chunk", [1, 5, 1 << 16])
def test_broken_xml(chunk):
    reader = read("<a><b>R & D < 3</b></x><b>open<c>deep</b><d>last".encode() + b"\xff", chunk)
    assert [(p, x) for p, _, _, x in reader.done] == [("/a[1]/b[1]", "R & D < 3"), ("/a[1]/b[2]/c[1]", "deep"), ("/a[1]/b[2]", "open"), ("/a[1]/d[1]", "last�")]
    assert reader.faults == 6  # &, <, </x>, <c> left open, <d> and <a> at the end


def test_entries_and_records(spark, tmp_path):
    codes = "<result>" + "".join(f"<list><code>{i}</code><name>N{i} &amp; Co</name>{'<stock> 00' + str(i) + ' </stock>' if i % 2 else ''}</list>" for i in range(5000)) + "</result>"
    zipped(tmp_path / "a.zip", {"CODES.XML": codes, "note.txt": "<no/>", "b.xml": "<r><p>x</p></r>"})
    zipped(tmp_path / "b.zip", {"bad.xml": "<r><p>one<p>two</r>"})
    got = xml.blocks(spark, f"file:{tmp_path}/*.zip", "b*.xml").collect()
    assert sorted((x.entry, x.seq, x.xpath, x.text, x.faults) for x in got) == [("b.xml", 0, "/r[1]/p[1]", "x", 0), ("bad.xml", 0, "/r[1]/p[1]/p[1]", "two", 2), ("bad.xml", 1, "/r[1]/p[1]", "one", 2)]
    rows = xml.records(spark, f"file:{tmp_path}/a.zip", "list", ["code", "stock", "name"], "codes.xml").orderBy("seq").collect()
    assert [(x.code, x.stock, x.name) for x in rows] == [(str(i), f"00{i}" if i % 2 else None, f"N{i} & Co") for i in range(5000)]


def test_memory_is_flat():
    piece = b"<row><a>" + b"text " * 50 + b"</a><b k='v'/></row>" * 3
    tracemalloc.start()
    reader = xml.Reader()
    reader.feed(b"<all>")
    for _ in range(30_000):  # 10 MB
        reader.feed(piece)
        reader.done.clear()
    reader.close()
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
    assert io is not None
