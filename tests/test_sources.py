"""Readers over small files written here."""

import json

from vendorlens.operators.matching import company_profile
from vendorlens.sources import readers


def test_companies_skip_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({
        "slug": "acme", "name": "Acme", "web": "https://www.Acme.com/x", "email": "privacy@ACME.org", "categories": ["travel", "odd"],
        "suggested-transport-medium": "email", "unknown-key": 1}, indent=2))
    (tmp_path / "b.json").write_text("{ not json")
    (tmp_path / "c").write_text('{"slug": "stray", "name": "Stray"}')
    (tmp_path / "d.json").write_text('{"slug": "bare", "name": "Bare"}')
    got = {r["slug"]: r for r in readers.read_companies(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["acme", "bare"]
    assert got["acme"]["domains"] == ["acme.com", "acme.org"] and got["acme"]["categories"] == ["shopping"]
    assert got["bare"]["domains"] == [] and got["bare"]["categories"] is None
    profile = company_profile(readers.read_companies(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in profile] == [("unknown", 2, 1)]


def test_overrides(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text('{"_comment": "x",\n "ETid-1": "free-fr", "ETid-2": null}')
    got = sorted(tuple(r) for r in readers.read_overrides(spark, str(path)).collect())
    assert got == [("ETid-1", "free-fr"), ("ETid-2", None)]


def test_overrides_with_open_keys_and_broken_lines(spark, tmp_path):
    """Keys with dots and brackets, nested and null values; a broken line is reported and hides no other."""
    path = tmp_path / "o.json"
    path.write_text('{"ETid-1": "a.b", "x.y.z": "dots", "k[0]": "brackets", "n": {"deep": null}, "e": null, "": "empty"}\n{"ETid-2": "b"\n\n[1, 2]\n{"_c": 1, "num": 7}\n{}\n')
    got = {r["etid"]: r["company_slug"] for r in readers.read_overrides(spark, str(path), lines=True).collect()}
    assert got == {"ETid-1": "a.b", "x.y.z": "dots", "k[0]": "brackets", "n": '{"deep":null}', "e": None, "": "empty", "num": "7"}
    bad = sorted((r["file"], r["reason"].split(":")[0], r["text"]) for r in readers.broken_documents(spark, str(path), lines=True).collect())
    assert bad == [("o.json", "no JSON", '{"ETid-2": "b"'), ("o.json", "no object", "[1, 2]")]


def test_enforcement_and_releases(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"data": [["", "<b>ETid-1</b>"] + [""] * 11, ["x"] * 13]}))
    assert readers.read_enforcement(spark, str(tmp_path / "e.json")).count() == 2
    (tmp_path / "r.json").write_text(json.dumps([
        {"tag_name": "v1", "published_at": "2024-01-01T00:00:00Z", "assets": [{"name": "a.exe", "download_count": 3}]},
        {"tag_name": "v0", "published_at": "2023-01-01T00:00:00Z", "assets": []}]))
    got = sorted((r["tag"], r["asset"]) for r in readers.read_releases(spark, str(tmp_path / "r.json")).collect())
    assert got == [("v0", None), ("v1", "a.exe")]


def test_breaches(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"Name": "B", "Title": "T", "Domain": "", "DataClasses": ["Passwords"], "IsVerified": True}]))
    row = readers.read_breaches(spark, str(tmp_path / "b.json")).first()
    assert row["domain"] is None and row["data_classes"] == ["Passwords"] and row["is_verified"] and not row["is_sensitive"]
