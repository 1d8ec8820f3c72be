import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.functions import instants as I


def utc(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


NY, BER, UTC = ("America/New_York", "MDY"), ("Europe/Berlin", "DMY"), ("Etc/UTC", "YMD")


@pytest.mark.parametrize(
    "text, site, want",
    [
        ("2024-09-19 09:08:11", NY, "2024-09-19 13:08:11"),
        ("2024-02-22 18:42:57 UTC", NY, "2024-02-22 18:42:57"),
        ("23/06/2023 11:17", BER, "2023-06-23 09:17:00"),
        ("06/23/2023 11:17:00 PM", NY, "2023-06-24 03:17:00"),
        ("12.11.2025 08:24 Uhr", NY, "2025-11-12 13:24:00"),
        ("11/12/25 08:24", NY, "2025-11-12 13:24:00"),
        ("2025/5/16 10:03", BER, "2025-05-16 08:03:00"),
        ("45442.5", UTC, "2024-05-30 12:00:00"),
        ("45442", BER, "2024-05-29 22:00:00"),
        ("1715945021", BER, "2024-05-17 11:23:41"),
        ("20250702143809", UTC, "2025-07-02 14:38:09"),
        ("Fri, 28 Nov 2025 08:52:05 -0800", BER, "2025-11-28 16:52:05"),
        ("26 de mayo de 2023 12:45", BER, "2023-05-26 10:45:00"),
        ("17. Oktober 2024 09:12", BER, "2024-10-17 07:12:00"),
        ("Jan 28, 2026 1:24pm (EST)", NY, "2026-01-28 18:24:00"),
        ("February 26, 2025 at 1:00:01pm", UTC, "2025-02-26 13:00:01"),
        ("2023-12-08T05:14:32+01:00[Europe/Berlin]", NY, "2023-12-08 04:14:32"),
        ("2023-08-30 17:37:23-04", BER, "2023-08-30 21:37:23"),
        ("07/30/2024 2:26:07 A.M.", NY, "2024-07-30 06:26:07"),
        ("2024-11-03 01:30:00", NY, "2024-11-03 05:30:00"),  # shown twice: the first passage
        ("2024-11-03 01:30:00 EST", NY, "2024-11-03 06:30:00"),
        (" 2023-02-17\t", UTC, "2023-02-17 00:00:00"),
    ],
)
def test_written_forms(text, site, want):
    assert I.to_utc(text, *site) == utc(want)


@pytest.mark.parametrize("text", [None, "", "-", "null", "pending", "########", "2024-02-30 10:15:00", "2023-13-04 08:00:00", "00.00.0000 00:00", "2024-03-10 02:30:00", "2024-01-01 25:00:00", "2024-05-05 10:00 XYZ", "x" * 500])
def test_no_instant(text):
    assert I.to_utc(text, *NY) is None


def test_no_zone_needs_a_site():
    assert I.to_utc("2024-01-01 10:00:00", None, None) is None
    assert I.to_utc("2024-01-01 10:00:00Z", None, None) == utc("2024-01-01 10:00:00")


@given(st.datetimes(dt.datetime(2000, 1, 1), dt.datetime(2036, 12, 31)), st.sampled_from(["America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Sydney"]))
def test_round_trip_of_any_instant(t, zone):
    from zoneinfo import ZoneInfo

    at = t.replace(tzinfo=dt.timezone.utc)
    local = at.astimezone(ZoneInfo(zone))
    got = I.to_utc(local.isoformat(), zone, "MDY")
    assert got == int((at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def test_operator_and_zone_estimate(spark):
    from zoneinfo import ZoneInfo

    from ledgerloom.operators import instants

    rows = []
    for k in range(300):
        at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=29 * k)
        rows.append((k, at.astimezone(ZoneInfo("America/Chicago")).strftime("%Y-%m-%d %H:%M:%S"), "A", (at + dt.timedelta(minutes=20)).replace(tzinfo=None)))
    rows += [(900, None, "A", None), (901, "pending", None, None), (902, "2024-01-01T00:00:00Z", None, None)]
    df = spark.createDataFrame(rows, "id long, text string, site_code string, loaded_at timestamp_ntz")
    zones = spark.createDataFrame([("B", "America/New_York", "MDY"), ("C", "America/Chicago", "MDY"), ("D", "Europe/Berlin", "DMY")], "site_code string, zone_name string, date_order string")
    done = instants.complete_zones(zones, df, "text")
    assert {r.site_code: r.zone_name for r in done.collect()}["A"] == "America/Chicago"
    out = {r.id: r.utc_micros for r in instants.with_utc(df, done, "text").collect()}
    assert len(out) == len(rows) and out[0] == utc("2024-01-01 00:00:00") and out[900] is None and out[901] is None and out[902] == utc("2024-01-01 00:00:00")
    assert instants.with_utc(df.limit(0), zones, "text").count() == 0
