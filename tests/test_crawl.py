"""The crawl of a directory tree keeps files of any size."""

from __future__ import annotations

from quarry.sources.filters import crawl


def test_large_files_stay(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "small.txt").write_bytes(b"x" * 100)
    for name, size in (("large.bin", (1 << 26) + 1), ("huge.bin", (1 << 31) + 5)):
        with (tmp_path / name).open("wb") as f:
            f.truncate(size)
    got = {r["url"].rsplit("/", 1)[1]: r["size"] for r in crawl(spark, str(tmp_path)).select("url", "size").collect()}
    assert got == {"small.txt": 100, "large.bin": (1 << 26) + 1, "huge.bin": (1 << 31) + 5}
    (tmp_path / "large.bin").unlink()
    rows = {r["url"].rsplit("/", 1)[1]: r["content"] for r in crawl(spark, str(tmp_path)).collect()}
    assert bytes(rows["small.txt"]) == b"x" * 100 and rows["huge.bin"] is None
    assert {r["size"]: r["content"] for r in crawl(spark, str(tmp_path), 50).collect()} == {100: None, (1 << 31) + 5: None}
