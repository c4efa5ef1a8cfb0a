"""Paged requests and the group commit of months that are asked for in parts."""

import json

import pytest

from resalelens.sources import month_source as M


def _pages(folder, month, files, size=7):
    d = folder / f"month={month}"
    d.mkdir(exist_ok=True)
    at = 0
    for k in range(files):
        lines = []
        for _ in range(3):
            lines.append(json.dumps({"result": {"records": [{"month": month, "town": f"{month}-{at + i}"} for i in range(size)]}}))
            at += size
        (d / f"p{k}.json").write_text("\n".join(lines) + "\n")
    return at


def _towns(df):
    return sorted(r.town for r in df.collect())


def test_eight_parts_are_eight_tasks_and_commit_together(spark, tmp_path):
    n = _pages(tmp_path, "2024-01", 8)
    _pages(tmp_path, "2024-02", 8)
    pages = M.StoredPages(spark, str(tmp_path))
    asked = M._requested(spark, pages, ["2024-01"], ["month", "town"], 5, None, "skip")
    assert asked.rdd.getNumPartitions() == 8
    assert M.read_month_source(spark, pages, ["2024-01", "2024-02"], ["month", "town"], on_error="skip").count() == 2 * n
    (tmp_path / "month=2024-01" / "p3.json").write_text('{"result": {"records": [{"month": "2024-01"}]}}\n{broken')
    rows, failed = M.request_months(spark, pages, ["2024-01", "2024-02"], ["month", "town"])
    assert {r.month for r in rows.collect()} == {"2024-02"} and rows.count() == n
    assert [(r.month, r.part) for r in failed.collect()] == [("2024-01", 3)] and "p3.json" in failed.first().error


@pytest.mark.parametrize("limit", [0, 1, 20, 21, 22, 50, 1000])
def test_limit_takes_the_first_records_of_the_parts_in_order(spark, tmp_path, limit):
    n = _pages(tmp_path, "2024-01", 3)
    _pages(tmp_path, "2024-02", 1)
    pages = M.StoredPages(spark, str(tmp_path))
    got = M.read_month_source(spark, pages, pages.months(), ["month", "town"], limit=limit)
    want = [f"2024-01-{i}" for i in range(min(limit, n))] + [f"2024-02-{i}" for i in range(min(limit, 21))]
    assert _towns(got) == sorted(want)


def test_limit_without_skip_raises(spark, tmp_path):
    _pages(tmp_path, "2024-01", 1)
    (tmp_path / "month=2024-01" / "p1.json").write_text("{broken")
    pages = M.StoredPages(spark, str(tmp_path))
    with pytest.raises(Exception, match="cannot be read"):
        M.read_month_source(spark, pages, ["2024-01"], ["month"], limit=1000).count()


@pytest.mark.parametrize("size", [1, 5, 7, 10, 1000])
def test_cursor_pages_yield_every_record_once(spark, tmp_path, size):
    n = _pages(tmp_path, "2024-01", 2)
    (tmp_path / "month=2024-01" / "p1b.json").write_text("\n")  # a file of no pages
    pages = M.StoredPages(spark, str(tmp_path))
    got, cursor, calls = [], None, 0
    while True:
        records, cursor = pages.page("2024-01", ["town"], None, cursor, size)
        assert len(records) <= size
        got += [r["town"] for r in records]
        calls += 1
        if cursor is None:
            break
    assert got == [f"2024-01-{i}" for i in range(n)] and calls >= n // size
    df = M.read_month_source(spark, M.CursorPages(pages.page), ["2024-01", "2030-01"], ["month", "town"])
    assert _towns(df) == sorted(got)


def test_pages_are_asked_again_and_given_on_once():
    tries = {}

    def page(month, fields, header, cursor):
        at = int(cursor or 0)
        tries[at] = tries.get(at, 0) + 1
        if tries[at] < 3:
            raise ConnectionError("lost")
        return [{"month": month, "i": k} for k in range(at, min(at + 4, 10))], str(at + 4) if at + 4 < 10 else None

    assert [r["i"] for r in M.CursorPages(page)("2024-01", ["i"], None)] == list(range(10))
    tries.clear()
    with pytest.raises(ConnectionError):
        list(M.CursorPages(page, retries=1)("2024-01", ["i"], None))
    with pytest.raises(M.FetchError, match="circle"):
        list(M.CursorPages(lambda *a: ([], "same"))("2024-01", ["i"], None))


def _service(n, most, grows=False):
    """Answers at most ``most`` records a call."""
    def call(month, fields, header, offset, limit):
        total = n + (offset > 0 and grows)
        return {"total": total, "records": [{"month": month, "town": f"{i}"} for i in range(offset, min(offset + min(limit, most), n))]}

    return call


def test_offset_pages(spark):
    for n, most, size in ((0, 100, 100), (1, 100, 100), (250, 100, 100), (250, 30, 100), (300, 100, 100)):
        fetch = M.OffsetPages(_service(n, most), size)
        df = M.read_month_source(spark, fetch, ["2024-01"], ["month", "town"])
        assert df.rdd.getNumPartitions() == max(1, -(-n // size))
        assert _towns(df) == sorted(str(i) for i in range(n))
        assert M.read_month_source(spark, fetch, ["2024-01"], ["month", "town"], limit=120).count() == min(n, 120)
        assert [r["town"] for r in fetch("2024-01", ["town"], None)] == [str(i) for i in range(n)]
    moving = M.OffsetPages(_service(250, 100, grows=True), 100)
    with pytest.raises(Exception, match="changed between two pages"):
        M.read_month_source(spark, moving, ["2024-01"], ["month", "town"]).count()
    rows, failed = M.request_months(spark, moving, ["2024-01"], ["month", "town"])
    assert rows.count() == 0 and {r.part for r in failed.collect()} == {1, 2}
