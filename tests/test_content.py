"""Content parts read piece by piece against a walk of the whole tree."""

import random
import subprocess
import sys
import xml.etree.ElementTree as ET

import pytest

from galley.sources import ooxml
from galley.sources.ooxml import _bag, _child, _content_rows, _get, _local, _text

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def plain(p):
    return all(_local(c) in ooxml._HARMLESS or (_local(c) == "r" and all(_local(x) in ("rPr", "t", "tab") for x in c)) for c in p)


def by_tree(data):
    """The rows by recursion over the finished tree."""
    counts, out = {}, []

    def number(kind):
        counts[kind] = counts.get(kind, -1) + 1
        return counts[kind]

    def walk(node, in_cell, para, table):
        name = _local(node)
        if name in ooxml._OWNERS:
            kind, holder, style = ooxml._OWNERS[name]
            props, at = _child(node, holder), number(kind)
            row = {"kind": kind, "ord": at, "parent_ord": {"run": para, "table": table}.get(kind), "style_id": _get(_child(props, style)), "has_bag": props is not None, "bag": _bag(props), "in_table": in_cell}
            if kind == "paragraph":
                row |= {"plain": plain(node), "text": "".join(_text(c) for c in node if _local(c) == "r")}
                para = at
            elif kind == "run":
                row["text"] = _text(node)
            else:
                table = at
            out.append(row)
        elif name in ooxml._BARE:
            kind = ooxml._BARE[name]
            out.append({"kind": kind, "ord": number(kind), "parent_ord": table, "has_bag": True, "bag": _bag(node)})
        elif name in ooxml._REVISIONS:
            out.append({"kind": "revision", "ord": number("revision"), "revised": True})
        for c in node:
            walk(c, in_cell or name == "tc", para, table)

    walk(ET.fromstring(data), False, None, None)
    return out


def document(seed):
    rng = random.Random(seed)

    def some(inner, depth):
        return "".join(inner(depth) for _ in range(rng.randint(0, 3)))

    def props(name):
        inner = rng.choice(['<w:pStyle w:val="A"/>', '<w:rStyle w:val="B"/>', '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="2"/></w:numPr>', '<w:rPr><w:ins w:id="1"/><w:b/></w:rPr>', '<w:sectPr><w:pgSz w:w="1"/></w:sectPr>', "<w:pPrChange/>"])
        return rng.choice(["", f"<w:{name}>{inner}<w:jc w:val='x'/></w:{name}>"])

    def run(depth):
        inner = rng.choice(["<w:t>é &amp; text</w:t>", "<w:t/><w:tab/>", "<w:drawing/>", "<w:t>a<!-- c -->b</w:t>"])
        box = f"<w:pict>{some(paragraph, depth + 1)}</w:pict>" if depth < 3 and rng.random() < 0.2 else ""
        return f"<w:r>{props('rPr')}{inner}{box}</w:r>"

    def piece(depth):
        return rng.choice([run, run, lambda d: f"<w:ins>{run(d)}</w:ins>", lambda d: '<w:bookmarkStart w:id="1"/>', lambda d: f"<w:hyperlink>{run(d)}</w:hyperlink>"])(depth)

    def paragraph(depth):
        return f"<w:p>{props('pPr')}{some(piece, depth)}</w:p>"

    def table(depth):
        cell = lambda d: f"<w:tc>{props('tcPr')}{some(block, d + 1)}</w:tc>"
        row = lambda d: f"<w:tr>{props('trPr')}{some(cell, d)}</w:tr>"
        return f"<w:tbl>{props('tblPr')}{some(row, depth)}</w:tbl>"

    def block(depth):
        return (table if depth < 3 and rng.random() < 0.3 else paragraph)(depth)

    return f"<w:document {W}><w:body>{''.join(block(0) for _ in range(12))}<w:sectPr><w:pgSz w:w='2'/></w:sectPr></w:body></w:document>".encode()


@pytest.mark.parametrize("feed", [7, 100, 1 << 16])
def test_rows_equal_a_walk_of_the_tree(monkeypatch, feed):
    monkeypatch.setattr(ooxml, "_FEED", feed)
    key = lambda r: (r["kind"], r["ord"])
    for seed in range(60):
        data = document(seed)
        assert sorted(_content_rows(data), key=key) == sorted(by_tree(data), key=key)


LARGE = """
import resource, sys
from galley.sources.ooxml import _content_rows
one = b'<w:p><w:pPr><w:pStyle w:val="Body"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>some words of text</w:t></w:r></w:p>'
n = (60 << 20) // len(one)
data = b'<w:document xmlns:w="x"><w:body><w:tbl><w:tr><w:tc>' + one * n + b'</w:tc></w:tr></w:tbl></w:body></w:document>'
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = sum(1 for _ in _content_rows(data))
assert rows == 2 * n + 1, rows
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_memory_does_not_follow_the_part():
    used = subprocess.run([sys.executable, "-c", LARGE], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(ooxml.__file__).parents[2]))
    assert used.returncode == 0, used.stderr
    assert int(used.stdout) < 30  # MB beyond the 60 MB of bytes; the tree took about a gigabyte
