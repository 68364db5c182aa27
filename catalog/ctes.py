"""Common table expressions of the check queries, in DuckDB SQL.

They restate the derived tables independently of the Spark code, from the base
tables only. ``sql(select, *names)`` prefixes a select with what it needs.
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], text: str) -> None:
    CTES[name] = (needs, text.strip())


def _collect(name: str, done: list[str]) -> None:
    if name in done:
        return
    for needed in CTES[name][0]:
        _collect(needed, done)
    done.append(name)


def sql(select: str, *names: str) -> str:
    done: list[str] = []
    for name in names:
        _collect(name, done)
    parts = [f"{n} as ({CTES[n][1]})" for n in done]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + select.strip()


cte("agg", (), """
  select n_name as station, cast(n_nationkey as int) as skey, cast(l_shipdate as date) as obs_date,
         count(*) as n,
         sum(cast(l_quantity as bigint)) as q, min(cast(l_quantity as bigint)) as qmin, max(cast(l_quantity as bigint)) as qmax,
         sum(cast(floor(l_extendedprice) as bigint)) as price,
         sum(cast(round(l_discount * 100) as bigint)) as disc, sum(cast(round(l_tax * 100) as bigint)) as tax
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  group by 1, 2, 3""")

cte("panel", ("agg",), """
select station, obs_date,
  case when (dayofyear(obs_date) + skey) % 11 = 0 or obs_date < date '1995-01-10' then null else cast(4 * q as double) / n end as pm25,
  case when (dayofyear(obs_date) + 2 * skey) % 13 = 0 then null else cast(price as double) / (1000 * n) end as pm10,
  case when skey % 3 = 0 and dayofyear(obs_date) between 100 and 105 then null else cast(disc as double) / n end as so2,
  cast(tax as double) / n as co, cast(qmin as double) as o3, cast(qmax as double) as no2,
  cast(greatest(qmax, disc) as double) as max_idx
from agg""")

cte("tok", ("panel",), """
select *, case day(obs_date) % 4 when 0 then 'N/A' when 1 then 'null' when 2 then 'TIDAK ADA DATA' else '---' end as t from panel""")

cte("raw", ("tok",), """
select cast(year(obs_date) * 100 + month(obs_date) as varchar) as periode_data, cast(day(obs_date) as varchar) as tanggal, station as stasiun,
  coalesce(cast(pm25 as varchar), t) as pm_duakomalima, coalesce(cast(pm10 as varchar), t) as pm_sepuluh, coalesce(cast(so2 as varchar), t) as sulfur_dioksida,
  cast(co as varchar) as karbon_monoksida, cast(o3 as varchar) as ozon, cast(no2 as varchar) as nitrogen_dioksida, cast(max_idx as varchar) as max, cast(month(obs_date) as int) as bulan
from tok
union all
select cast(year(obs_date) * 100 + 2 as varchar), '30', station, '1', '1', '1', '1', '1', '1', '1', cast(2 as int) from panel where month(obs_date) = 2 and day(obs_date) = 28""")

cte("typed", ("raw",), """
select cast(periode_data as int) as periode_data, cast(bulan as int) as bulan, stasiun as station,
  cast(try_strptime(periode_data || '-' || tanggal, '%Y%m-%d') as date) as obs_date,
  try_cast(pm_duakomalima as double) as pm25, try_cast(pm_sepuluh as double) as pm10, try_cast(sulfur_dioksida as double) as so2,
  try_cast(karbon_monoksida as double) as co, try_cast(ozon as double) as o3, try_cast(nitrogen_dioksida as double) as no2, try_cast(max as double) as max_idx
from raw where try_strptime(periode_data || '-' || tanggal, '%Y%m-%d') is not null""")


def ffill(column: str, over: str = "w", name: str | None = None) -> str:
    return f"last_value({column} ignore nulls) over {over} as {name or column}"


W = "window w as (partition by station order by obs_date rows between unbounded preceding and current row)"
FILLS = ", ".join(ffill(c) for c in ("pm25", "pm10", "so2", "co", "o3", "no2"))
GLOBAL_FILLS = ", ".join(ffill(c) for c in ("pm25", "pm10", "so2", "co", "o3", "no2", "max_idx"))

cte("filled", ("panel",), f"select station, obs_date, {FILLS}, max_idx from panel {W}")
cte("clean", ("typed",), f"select periode_data, bulan, station, obs_date, {FILLS}, max_idx from typed {W}")
cte("target", ("filled",), """
select * from (select station, obs_date, last_value(pm25 ignore nulls) over w as pm25, pm10, so2, co, o3, no2, max_idx, pm25 as pm25_original
from filled window w as (partition by station order by obs_date rows between unbounded preceding and current row)) where pm25 is not null""")

CALENDAR = """cast(isodow(obs_date) - 1 as int) as day_of_week, cast(month(obs_date) as int) as month, cast(year(obs_date) as int) as year,
  cast(dayofyear(obs_date) as int) as day_of_year, cast(quarter(obs_date) as int) as quarter,
  cast(case when isodow(obs_date) >= 6 then 1 else 0 end as int) as is_weekend,
  cast((month(obs_date) % 12 + 3) // 3 as int) as season,
  cast(case when month(obs_date) >= 10 or month(obs_date) <= 3 then 1 else 0 end as int) as is_rainy_season"""

LAGS = ", ".join(f"lag(pm25, {n}) over o as pm25_lag_{n}" for n in (1, 2, 3, 7, 14, 30))


def _rolling(n: int) -> str:
    w = f"r{n}"
    return ", ".join(
        f"case when count(pm25) over {w} = {n} then {e} end as pm25_rolling_{name}_{n}"
        for name, e in (
            ("mean", f"round(avg(pm25) over {w}, 6)"),
            ("std", f"round(stddev_samp(pm25) over {w}, 6)"),
            ("min", f"min(pm25) over {w}"),
            ("max", f"max(pm25) over {w}"),
        )
    )


ROLLING = ", ".join(_rolling(n) for n in (7, 14, 30))
CHANGES = "pm25 - lag(pm25, 1) over o as pm25_day_change, pm25 - lag(pm25, 7) over o as pm25_week_change"
O = "o as (partition by station order by obs_date)"
R = ", ".join(
    f"r{n} as (partition by station order by obs_date rows between {n - 1} preceding and current row)"
    for n in (7, 14, 30)
)
cte("hist", ("target",), f"select *, {CALENDAR}, {LAGS}, {ROLLING}, {CHANGES} from target window {O}, {R}")
cte("feat", ("hist",), "select * from hist where pm25_original is not null and pm10 is not null and so2 is not null and co is not null and o3 is not null and no2 is not null and max_idx is not null and pm25_lag_30 is not null and pm25_rolling_std_30 is not null")

cte("numbered", ("target",), """
select *, row_number() over (partition by station order by obs_date) as position, count(*) over (partition by station) as series_size from target""")
cte("split", ("numbered",), "select *, position <= floor(series_size * cast(0.8 as double)) as is_train from numbered")
cte("blocks0", ("split",), "select *, cast(floor(series_size * cast(0.8 as double)) as bigint) as train_size from split")
cte("blocks1", ("blocks0",), "select *, case when least(5, train_size // 10) >= 2 then least(5, train_size // 10) end as k from blocks0")
cte("blocks2", ("blocks1",), "select *, train_size // (k + 1) as t, train_size - k * (train_size // (k + 1)) as first from blocks1")
cte("blocks", ("blocks2",), """
select *, case when k is null or not is_train then null when position - 1 < first then 0 else 1 + (position - 1 - first) // t end as block from blocks2""")

cte("naive", ("blocks",), """
select station, obs_date, pm25 as label, is_train, case when is_train then 'train' else 'test' end as side, block,
  unnest(['Persistence1', 'Persistence7', 'WeekMean']) as model,
  unnest([lag(pm25, 1) over o, lag(pm25, 7) over o, case when count(pm25) over b = 7 then avg(pm25) over b end]) as prediction
from blocks window o as (partition by station order by obs_date), b as (partition by station order by obs_date rows between 7 preceding and 1 preceding)""")
cte("pred", ("naive",), "select * from naive where prediction is not null")
cte("test", ("pred",), "select * from pred where side = 'test'")

METRICS = """count(*) as n, avg(abs(label - prediction)) as mae, sqrt(avg((label - prediction) * (label - prediction))) as rmse,
  case when count(*) < 2 then null when max(label) = min(label) then (case when sum((label - prediction) * (label - prediction)) = 0 then 1.0 else 0.0 end)
       else 1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)) end as r2,
  100 * avg(abs(label - prediction) / greatest(abs(label), 2.220446049250313e-16)) as mape"""
cte("metric", ("pred",), f"select model, side, {METRICS} from pred group by model, side")
cte("folds", ("pred",), "select model, block as fold, avg(abs(label - prediction)) as fold_mae from pred where block >= 1 group by 1, 2")
cte("cv", ("folds",), "select model, avg(fold_mae) as cv_mae, stddev_pop(fold_mae) as cv_std from folds group by model")
WIDE = ", ".join(
    f"max(case when side = '{s}' then {m} end) as {s}_{m}" for m in ("mae", "rmse", "r2", "mape") for s in ("train", "test")
)
cte("wide", ("metric",), f"select model, {WIDE} from metric group by model")
cte("cmp", ("wide", "cv"), "select wide.*, cv_mae, cv_std, case model when 'Persistence1' then 0 when 'Persistence7' then 1 else 2 end as rank from wide left join cv using (model)")
cte("spread", ("test",), "select model, avg(prediction - label) as overall_bias, stddev_pop(prediction - label) as residual_std from test group by model")

# stand-in model: a fixed linear rule over the model inputs
LINEAR = "coalesce(pm10, 0) * 0.5 + coalesce(so2, 0) * 2 + coalesce(co, 0) + coalesce(o3, 0) * 0.25 + coalesce(no2, 0) * 0.1 + coalesce(max_idx, 0) * 0.01 + month * 0.3 + is_weekend * 1.5"
STD = 8.5

cte("recent", ("filled",), "select *, row_number() over (partition by station order by obs_date desc) as back from filled")
cte("context", ("recent",), """
select station, max(obs_date) as last_date, max(case when back = 1 then pm25 end) as last_actual,
  avg(pm10) as pm10, avg(so2) as so2, avg(co) as co, avg(o3) as o3, avg(no2) as no2, avg(max_idx) as max_idx
from recent where back <= 7 group by station""")
cte("ahead", ("context",), """
select station, last_date, last_actual, h as horizon, last_date + cast(h as int) as obs_date, s as scenario, f as factor, l as scenario_label,
  pm10 * f as pm10, so2 * f as so2, co * f as co, o3 * f as o3, no2 * f as no2, max_idx * f as max_idx
from context, (values (1), (3), (7)) hz(h),
  (values ('normal', 1.0::double, 'Kondisi Normal'), ('increase', 1.1::double, 'Kenaikan Polusi (+10%)'), ('decrease', 0.9::double, 'Penurunan Polusi (-10%)')) sc(s, f, l)""")
cte("inputs", ("ahead",), f"""
select *, {CALENDAR}, cast(year(obs_date) * 100 + month(obs_date) as int) as periode_data, cast(month(obs_date) as int) as bulan from ahead""")
cte("scored", ("inputs",), f"select *, {LINEAR} as prediction from inputs")


def ladder(steps: list[tuple[str | None, str]]) -> str:
    whens = " ".join(f"when {c} then '{v}'" for c, v in steps if c)
    return f"case {whens} else '{steps[-1][1]}' end"


def category(v: str) -> str:
    return ladder([(f"{v} <= 50", "Baik"), (f"{v} <= 100", "Sedang"), (f"{v} <= 150", "Tidak Sehat"), (None, "Sangat Tidak Sehat")])


def badge(v: str) -> str:
    return ladder([(f"{v} <= 50", "success"), (f"{v} <= 100", "warning"), (f"{v} <= 150", "orange"), (None, "danger")])


def risk(v: str) -> str:
    return ladder([(f"{v} >= 150", "Kritis"), (f"{v} >= 100", "Tinggi"), (f"{v} >= 50", "Sedang"), (None, "Rendah")])


def risk_color(v: str) -> str:
    return ladder([(f"{v} >= 150", "danger"), (f"{v} >= 100", "orange"), (f"{v} >= 50", "warning"), (None, "success")])


def advice(level: str) -> str:
    return f"""case {level}
    when 'Kritis' then 'Hindari semua aktivitas di luar ruangan. Tutup jendela dan gunakan pembersih udara.'
    when 'Tinggi' then 'Kurangi aktivitas di luar ruangan. Kelompok rentan sebaiknya tetap di dalam ruangan. Gunakan masker jika harus keluar.'
    when 'Sedang' then 'Kelompok sensitif (lansia, anak-anak) sebaiknya membatasi aktivitas fisik di luar ruangan.'
    else 'Kualitas udara baik. Nikmati aktivitas di luar ruangan dengan normal.' end"""


def trend(v: str) -> str:
    return ladder([(f"{v} > 5", "Rising"), (f"{v} < -5", "Falling"), (None, "Stable")])


def confidence(v: str, std: str, words: tuple[str, str, str]) -> str:
    ratio = f"{std} / greatest({v}, 1.0)"
    return f"case when {v} is null then '{words[2]}' when {ratio} < 0.1 then '{words[0]}' when {ratio} < 0.25 then '{words[1]}' else '{words[2]}' end"


def level(v: str) -> str:
    return f"""case when {v} >= 0 and {v} <= 50 then 'Good' when {v} >= 51 and {v} <= 100 then 'Moderate'
    when {v} >= 101 and {v} <= 150 then 'Unhealthy' when {v} >= 151 then 'Very Unhealthy' end"""


cte("live", (), """
select event_id as reading_id, cast(ts as date) as arrival_date,
  case when event_id % 5 in (0, 1) then 0.0 else coalesce(value, 0.0) end as pm10, cast(0.0 as double) as so2,
  cast(user_id % 50 as double) as co, cast(event_id % 97 as double) as o3, coalesce(value, 0.0) as no2, cast(0.0 as double) as max_idx
from events""")
