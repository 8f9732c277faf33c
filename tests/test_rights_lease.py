"""Rights by path prefix against trying every row, every refusal, and leases of two writers."""

import random
import threading
from urllib.parse import unquote, urlsplit

import pytest

from priorlens.operators import rights
from priorlens.sources import lease

GOOD = {
    "source_id": "S", "domain": "News.example.com", "url_path_prefix": "/a/", "rights_status": "verified", "authorization_kind": "public_permission", "authorization_evidence_ref": "https://x.example/terms", "source_type": "open", "contract_confirmation_status": "",
    "contract_evidence_ref": "", "authorization_valid_from": "2024-01-01", "authorization_valid_to": "unlimited", "terms_url": "https://x.example/t", "terms_checked_at": "2024-02-02T10:00:00", "authentication": "none", "available_from": "2024-01-01", "available_to": "2024-12-31",
} | {k: "allowed" for k in rights.PERMISSIONS}


def test_every_refusal_in_order(spark):
    cases = [
        ({}, "verified_local_collection_only"), ({"url": "https://u:p@news.example.com/a/1"}, "invalid_or_credentialed_url"), ({"url": "https://news.example.com/a/../b"}, "invalid_or_credentialed_url"), ({"url": "https://news.example.com/a/1?api_key=2"}, "invalid_or_credentialed_url"),
        ({"url": "https://news.example.com:8080/a/1"}, "invalid_or_credentialed_url"), ({"url": None}, "invalid_or_credentialed_url"), ({"url": "https://news.example.com/b"}, "missing_or_ambiguous_domain_path_rights"), ({"more": (GOOD | {"url_path_prefix": "/"},)}, "missing_or_ambiguous_domain_path_rights"),
        ({"rights_status": "unresolved"}, "rights_not_verified"), ({"authorization_kind": "hearsay"}, "authorization_kind_unverified"), ({"authorization_evidence_ref": ""}, "authorization_evidence_missing"), ({"source_type": "licensed_feed"}, "licensed_source_requires_contract"),
        ({"authorization_kind": "contract"}, "contract_not_verified"), ({"authorization_kind": "contract", "contract_confirmation_status": "verified", "contract_evidence_ref": "https://x.example/c", "source_type": "licensed"}, "verified_local_collection_only"),
        ({"authorization_valid_from": "soon"}, "authorization_validity_unknown"), ({"authorization_valid_to": "2024-12-31"}, "authorization_not_currently_valid"), ({"terms_url": "ftp://x"}, "missing_terms_basis"), ({"terms_checked_at": "2024-13-02"}, "missing_terms_check_date"),
        ({"ai_training": "maybe"}, "unrecorded_permission_ai_training"), ({"raw_storage": "denied"}, "permission_not_allowed_raw_storage"), ({"ai_training": "denied"}, "verified_local_collection_only"), ({"authentication": "token"}, "authentication_requires_provider_adapter"),
        ({"published": "5 May 2024"}, "publisher_date_unknown_for_coverage"), ({"available_to": ""}, "publication_coverage_unknown"), ({"published": "2025-01-01T00:00"}, "publication_outside_verified_coverage"),
    ]
    requests, registry = [], []
    for i, (changes, _) in enumerate(cases):  # a source of its own for each case
        changes = {"url": "https://news.example.com/a/1", "published": "2024-05-05", "more": (), **changes}
        requests.append((i, f"S{i}", changes.pop("url"), changes.pop("published")))
        registry += [GOOD | more | {"source_id": f"S{i}"} for more in ({}, *changes.pop("more"))]
        registry[-1 if len(registry) == 1 or registry[-2]["source_id"] != f"S{i}" else -2] |= changes
    registry = spark.createDataFrame([tuple(r[k] for k in GOOD) for r in registry], ", ".join(f"{k} string" for k in GOOD))
    got = rights.decisions(spark.createDataFrame(requests, "request_id long, source_id string, url string, published string"), registry, "2025-01-01").orderBy("request_id").collect()
    assert [g.reason for g in got] == [want for _, want in cases]
    assert all(g.allowed == (g.reason == "verified_local_collection_only") for g in got)


def test_prefixes_by_key(spark):
    r = random.Random(5)
    paths = ["/" + "/".join(r.choice(["a", "b", "ab", "%41", "x+y", "ü"]) for _ in range(r.randint(0, 4))) for _ in range(300)]
    requests = [(i, r.choice("ST"), f"https://{r.choice(['h.com', 'H.com', 'g.org'])}{p}") for i, p in enumerate(paths)]
    registry = [(r.choice("ST"), r.choice(["h.com", "G.org"]), p[: r.randint(0, len(p))]) for p in paths[:60]] + [("S", "h.com", "a"), (None, "h.com", "/"), ("S", "h.com", None)]
    want = sorted((i, q) for i, s, u in requests for t, d, q in registry if q and q.startswith("/") and s == t and urlsplit(u).hostname == d.lower() and unquote(urlsplit(u).path or "/").startswith(q))
    q = spark.createDataFrame(requests, "request_id long, source_id string, url string")
    p = rights.url_parts(q["url"])
    q = q.withColumns({"host": p["host"], "path": p["path"]})
    rows = spark.createDataFrame(registry, "source_id string, domain string, url_path_prefix string")
    found = rights.covering(q, rows)
    assert sorted((x.request_id, x.right.url_path_prefix) for x in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    best = {x.request_id: x.prefix_length for x in rights.longest(q, rows).collect()}
    assert best == {i: max(len(b) for a, b in want if a == i) for i in {i for i, _ in want}}


def test_two_writers(spark, tmp_path):
    folder = f"file:{tmp_path}/store"
    got, lost, start = [], [], threading.Barrier(2)

    def take(name):
        start.wait()
        try:
            got.append(lease.acquire(spark, folder, name, 60))
        except lease.Held:
            lost.append(name)

    threads = [threading.Thread(target=take, args=(x,)) for x in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got) == len(lost) == 1
    (mine,) = got
    assert lease.commit(spark, mine, {"table": "t1"}) == 1
    with pytest.raises(lease.Held, match="is held by"):
        lease.acquire(spark, folder, "c")
    import time

    other = lease.acquire(spark, folder, "c", now=time.time() + 61)  # the first writer's time is over
    assert other.number == mine.number + 1
    for f in (lambda: lease.commit(spark, mine, {"table": "old"}), lambda: lease.release(spark, mine)):
        with pytest.raises(lease.Stale):
            f()
    assert lease.commit(spark, other, {"table": "t2"}) == 2
    # a commit of the lost lease that slipped in is passed over
    assert lease._create(spark, f"{folder}/commit-{3:012d}", {"lease": mine.number, "owner": "a", "published": {"table": "late"}})
    assert lease.commit(spark, other, {"table": "t3"}) == 4
    assert [p["table"] for _, p in lease.commits(spark, folder)] == ["t1", "t2", "t3"]
    lease.release(spark, other)
    with pytest.raises(lease.Stale):
        lease.commit(spark, other, {"table": "t4"})
    assert lease.acquire(spark, folder, "d").number == other.number + 1


def test_dead_claim(spark, tmp_path):
    """A writer that died between its claim and its lease holds others off for a while, then its number is passed over."""
    folder = f"file:{tmp_path}/store"
    (tmp_path / "store").mkdir()
    (tmp_path / "store/lease-000000000001.claim").touch()
    with pytest.raises(lease.Held):
        lease.acquire(spark, folder, "a", 600)
    import time

    assert lease.acquire(spark, folder, "a", 600, now=time.time() + 700).number == 2
