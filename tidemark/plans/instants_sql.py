"""SQL that reads the times of gauge_readings by a parse of its own, for the checks of the series queries.

``INSTANTS`` is a CTE list that ends in placed(reading_id, utc_us, utc): the instant of every reading in microseconds and, as
a timestamp, to the second, null where its text denotes none. It knows the notations of the given tables and zones whose clocks go back at
01:00 UTC, and leaves clock times of files without a zone alone; those tables hold no readable one.
"""

from __future__ import annotations

FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y%m%d %H%M%S", "%Y%m%d %H%M", "%a, %d %b %Y %H:%M:%S", "%d-%b-%Y %H:%M:%S", "%Y-%j %H:%M:%S", "%Y-%j %H:%M"]
ORDERED = {"dmy": ("%d/%m/%y", "%d/%m/%Y"), "mdy": ("%m/%d/%y", "%m/%d/%Y"), "ymd": ("%y/%m/%d",)}
TIMES = ["%H:%M:%S", "%H:%M", "%I:%M:%S %p", "%I:%M %p"]


def _read(formats: list[str]) -> str:
    return f"try_strptime(b, {formats!r})"


def _off(instant: str) -> str:
    """Offset of the row's zone at an instant given as UTC time."""
    return f"(((({instant}) AT TIME ZONE 'UTC') AT TIME ZONE cz) - ({instant}))"


_ordered = " ".join(f"WHEN '{o}' THEN {_read([f'{d} {t}' for d in days for t in TIMES])}" for o, days in ORDERED.items())
INSTANTS = rf"""gf AS (SELECT file_id AS fid, max(clock_zone) AS cz, lower(trim(max(date_order))) AS dord FROM gauge_files GROUP BY 1),
i0 AS (SELECT reading_id, file_id, line_no, cz, dord, regexp_replace(upper(trim(datetime)), '(:\d\d:\d\d)[.,]\d{{1,9}}', '\1') AS x,
 CAST(rpad(left(regexp_extract(trim(datetime), ':\d\d:\d\d[.,](\d{{1,9}})', 1), 6), 6, '0') AS BIGINT) AS frac FROM gauge_readings LEFT JOIN gf ON fid = file_id),
i1 AS (SELECT *, regexp_extract(x, '(?:\d|[AP]M) ?(Z|GMT|UTC|IST|BST|CET|CEST|[+-]\d\d(?::?\d\d)?)$', 1) AS z FROM i0),
i2 AS (SELECT *, replace(regexp_replace(CASE WHEN z = '' THEN x ELSE trim(left(x, length(x) - length(z))) END, '^(\d[\d-]*\d)T(\d)', '\1 \2'), '  ', ' ') AS c FROM i1),
i4 AS (SELECT *, regexp_matches(c, ' 24(:?00){{1,2}}$') AS midnight, CASE WHEN regexp_matches(c, ' 24(:?00){{1,2}}$') THEN replace(replace(c, ' 24:', ' 00:'), ' 2400', ' 0000') ELSE c END AS c2 FROM i2),
i5 AS (SELECT *, CASE WHEN regexp_matches(c2, '^\d{{4}}/') THEN replace(c2, '/', '-') WHEN regexp_matches(c2, '^\d{{1,2}}[./-]\d') THEN replace(replace(c2, '.', '/'), '-', '/') ELSE c2 END AS b FROM i4),
i6 AS (SELECT *, CASE WHEN regexp_matches(b, '^\d{{1,2}}/') THEN CASE dord {_ordered} END ELSE {_read(FORMATS)} END + CASE WHEN midnight THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS t FROM i5),
i7 AS (SELECT *, CASE WHEN regexp_matches(x, '^\d{{1,11}}$') THEN make_timestamp(CAST(x AS BIGINT) * 1000000) WHEN regexp_matches(x, '^\d{{12,14}}$') THEN make_timestamp(CAST(x AS BIGINT) * 1000) END AS epoch,
 CASE WHEN z IN ('Z', 'GMT', 'UTC') THEN 0 WHEN z IN ('IST', 'BST', 'CET') THEN 60 WHEN z = 'CEST' THEN 120 WHEN z <> '' THEN
  (CAST(substr(z, 2, 2) AS INT) * 60 + CAST('0' || regexp_extract(z, '^.\d\d:?(\d\d)$', 1) AS INT)) * CASE left(z, 1) WHEN '-' THEN -1 ELSE 1 END
 WHEN cz IN ('UTC', 'GMT', 'Etc/UTC') THEN 0 WHEN regexp_matches(cz, '^[+-]\d\d:\d\d$') THEN (CAST(substr(cz, 2, 2) AS INT) * 60 + CAST(substr(cz, 5, 2) AS INT)) * CASE left(cz, 1) WHEN '-' THEN -1 ELSE 1 END
 WHEN cz LIKE 'Etc/GMT%' THEN -CAST(substr(cz, 8) AS INT) * 60 END AS mins FROM i6),
i8 AS (SELECT reading_id, file_id, line_no, cz, t, coalesce(epoch, t - mins * INTERVAL 1 MINUTE) AS fixed, epoch IS NULL AND mins IS NULL AND t IS NOT NULL AND cz LIKE 'Europe/%' AS moves FROM i7),
i9 AS (SELECT *, t - {_off("t - INTERVAL 1 DAY")} AS ua, t - {_off("t + INTERVAL 1 DAY")} AS ub FROM i8 WHERE moves),
i10 AS (SELECT *, CASE WHEN t - {_off("ua")} = ua THEN ua WHEN t - {_off("ub")} = ub THEN ub END AS u1, CASE WHEN t - {_off("ub")} = ub THEN ub WHEN t - {_off("ua")} = ua THEN ua END AS u2 FROM i9),
nr AS (SELECT reading_id, file_id, line_no, u1, u2 FROM i10 WHERE u1 IS NOT NULL UNION ALL SELECT reading_id, file_id, line_no, fixed, fixed FROM i8 WHERE NOT moves AND fixed IS NOT NULL),
am AS (SELECT DISTINCT file_id, date_trunc('day', u2) + INTERVAL 1 HOUR AS chg FROM nr WHERE u1 <> u2),
cx AS (SELECT nr.*, chg, u1 <> u2 AS twice, u1 >= chg AS past, row_number() OVER (PARTITION BY file_id, chg ORDER BY line_no, u1, reading_id) - 1 AS i FROM nr JOIN am USING (file_id) WHERE abs(epoch(u1) - epoch(chg)) <= 21600),
bd AS (SELECT file_id, chg, count(*) AS n, coalesce(max(CASE WHEN NOT twice AND NOT past THEN i END), -1) + 1 AS lo, coalesce(min(CASE WHEN NOT twice AND past THEN i END), count(*)) AS hi FROM cx GROUP BY 1, 2),
us AS (SELECT file_id, chg, coalesce(median(CASE WHEN st > 0 THEN st END), 0) AS usual FROM (SELECT *, epoch(u1) - epoch(lag(u1) OVER (PARTITION BY file_id, chg ORDER BY i)) AS st FROM cx) GROUP BY 1, 2),
ks AS (SELECT file_id, chg, unnest(range(CASE WHEN hi < lo THEN 0 ELSE lo END, CASE WHEN hi < lo THEN n ELSE hi END + 1)) AS k FROM bd),
vs AS (SELECT file_id, chg, k, i, epoch(CASE WHEN i < k THEN u1 ELSE u2 END) - epoch(lag(CASE WHEN i < k THEN u1 ELSE u2 END) OVER (PARTITION BY file_id, chg, k ORDER BY i)) AS st FROM cx JOIN ks USING (file_id, chg)),
co AS (SELECT file_id, chg, k, round(coalesce(sum(CASE WHEN st <= 0 THEN 1e6 ELSE 0 END + sqrt(abs(st - usual) / 3600)), 0), 6) AS cost FROM vs JOIN us USING (file_id, chg) GROUP BY ALL),
sw AS (SELECT file_id, chg, arg_min(k, (cost, k)) AS k FROM co GROUP BY 1, 2),
fo AS (SELECT reading_id, CASE WHEN i < k THEN u1 ELSE u2 END AS u FROM cx JOIN sw USING (file_id, chg) WHERE twice),
placed AS (SELECT g.reading_id, epoch_us(coalesce(fo.u, nr.u1)) + frac AS utc_us, date_trunc('second', coalesce(fo.u, nr.u1)) AS utc FROM i0 g LEFT JOIN nr USING (reading_id) LEFT JOIN fo USING (reading_id))"""
