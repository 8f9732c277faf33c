"""A package against its manifest: missing, extra and changed files."""

import hashlib

from priorlens.sources import package


def test_package(spark, tmp_path, monkeypatch):
    root = tmp_path / "run 1"
    (root / "raw").mkdir(parents=True)
    files = {"a.csv": b"id,name\n1,x\n\n2,y\n", "raw/b.jsonl": b'{"k": 1}\n' * 5000, "raw/c+d.bin": bytes(range(256)), "e.txt": b"", "f.csv": "größe\n1".encode()}
    for name, data in files.items():
        (root / name).write_bytes(data)
    folder = f"file:{root}"
    before = package.contents(spark, folder).cache()
    got = {r.path: r for r in before.collect()}
    assert {p: (r.bytes, r.sha256) for p, r in got.items()} == {p: (len(d), hashlib.sha256(d).hexdigest()) for p, d in files.items()}
    assert {p: (r.rows, r.header) for p, r in got.items()} == {"a.csv": (3, "id,name"), "raw/b.jsonl": (5000, '{"k": 1}'), "raw/c+d.bin": (None, None), "e.txt": (None, None), "f.csv": (2, "größe")}
    assert {r.status for r in package.verify_package(spark, folder, before).collect()} == {"ok"}
    (root / "a.csv").write_bytes(b"id,mane\n1,x\n\n2,y\n")
    (root / "f.csv").unlink()
    (root / "g.csv").write_bytes(b"new\n")
    (root / "raw/b.jsonl").write_bytes(b'{"k": 1}\n' * 4999 + b'{"k": 2}\n')
    found = {r.path: (r.status, r.reasons) for r in package.verify_package(spark, folder, before).collect()}
    assert found == {
        "a.csv": ("changed", ["sha256", "header", "lines_digest"]), "f.csv": ("missing", []), "g.csv": ("extra", []), "raw/b.jsonl": ("changed", ["sha256", "lines_digest"]), "raw/c+d.bin": ("ok", []), "e.txt": ("ok", []),
    }
    few = before.select("path", "rows")
    assert {r.path: r.status for r in package.verify_package(spark, folder, few.unionByName(few.where("path = 'e.txt'"))).collect()}["e.txt"] == "ambiguous"
    monkeypatch.setattr(package, "WHOLE", 100)  # files beyond the bound are told by size and lines
    found = {r.path: (r.status, r.reasons) for r in package.verify_package(spark, folder, before.drop("sha256")).collect()}
    assert found["raw/b.jsonl"] == ("changed", ["lines_digest"]) and {r.path: r.sha256 for r in package.contents(spark, folder).collect()}["raw/b.jsonl"] is None
