"""SQL counterparts of the queries, written the plain way: day spines, range joins, row numbers.

They share no code with the plans, which use interval expansion, monthly moments and windows.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

META = """
meta(series, name, code, freq, transform, release_lag_days, revision_type, vintage_source, vintage_mode, missing_policy) as (values
  ('revenue_growth', 'Quarterly growth of order revenue, percent', 'REVGROWTH', 'Q', '', 27, 'multi', 'alfred', 'latest', 'skip'),
  ('order_value', 'order_value', 'ORDVALUE', 'M', 'mom', 15, 'multi', 'alfred', 'latest', 'skip'),
  ('order_count', 'order_count', 'ORDCOUNT', 'M', 'diff', 7, 'multi', 'alfred', 'latest', 'skip'),
  ('ship_quantity', 'ship_quantity', 'SHIPQTY', 'M', 'mom', 14, 'multi', 'alfred', 'latest', 'skip'),
  ('discount_level', 'discount_level', 'DISCOUNT', 'M', 'level', 0, 'multi', 'alfred', 'latest', 'skip'),
  ('urgent_orders', 'urgent_orders', 'URGENT', 'W', 'log_diff', 1, 'single', 'final', 'latest', 'skip'))"""

VALUES = """
ord as (select o_orderkey k, cast(o_orderdate as date) d, cast(o_totalprice as decimal(18,2)) p, o_orderpriority pr from orders),
li as (select l_orderkey k, cast(l_shipdate as date) d, cast(l_quantity as decimal(18,2)) q, cast(l_discount as decimal(18,4)) disc from lineitem),
v(vint) as (values (0), (1)),
q as (select vint, cast(date_trunc('quarter', d) as date) rp, cast(sum(p) as double) s
      from ord cross join v where vint = 1 or k % 10 < 8 group by 1, 2),
qg as (select vint, rp, 100 * (s / lag(s) over (partition by vint order by rp) - 1) val from q),
m as (
  select 'order_value' series, vint, cast(date_trunc('month', d) as date) rp, cast(sum(p) as double) val
    from ord cross join v where vint = 1 or k % 10 < 9 group by 1, 2, 3
  union all select 'order_count', vint, cast(date_trunc('month', d) as date), cast(count(*) as double)
    from ord cross join v where vint = 1 or k % 10 < 9 group by 1, 2, 3
  union all select 'ship_quantity', vint, cast(date_trunc('month', d) as date), cast(sum(q) as double)
    from li cross join v where vint = 1 or k % 10 < 9 group by 1, 2, 3
  union all select 'discount_level', vint, cast(date_trunc('month', d) as date), cast(sum(disc) as double) / count(*)
    from li cross join v where vint = 1 or k % 10 < 9 group by 1, 2, 3
  union all select 'urgent_orders', 1, cast(cast(date_trunc('week', d) as date) + interval 5 days as date), cast(count(*) as double)
    from ord where pr = '1-URGENT' group by 1, 2, 3
  union all select 'revenue_growth', vint, rp, val from qg where val is not null)"""

CAL = """
dated as (
  select m.series, m.rp ref_period, m.vint, round(m.val, 6) as value, meta.vintage_source, meta.release_lag_days,
         case meta.freq when 'Q' then cast(m.rp + interval 3 months - interval 1 day as date) when 'M' then last_day(m.rp) else m.rp end period_end
  from m join meta on m.series = meta.series),
cal as (
  select series, ref_period,
         case when vintage_source = 'alfred' then cast(period_end + (release_lag_days + 30 * vint) * interval 1 day as date) end vintage_date,
         value, period_end,
         cast(period_end + release_lag_days * interval 1 day as date) release_date,
         cast(period_end + release_lag_days * interval 1 day as date) available_date
  from dated)"""

BASE = f"with recursive {META.strip()}, {VALUES.strip()}, {CAL.strip()}"
RAW = f"{BASE} select series, ref_period, vintage_date, value from cal"


def events(cal: str = "cal") -> str:
    return f"""ev as (
  select series, available_date, value, ref_period from (
    select *, row_number() over (partition by series, available_date order by ref_period desc nulls last, vintage_date desc nulls last) rn
    from {cal} where available_date is not null) where rn = 1)"""


def panel_from(cal: str, start: str, end: str, carry_from: str | None = None) -> str:
    """Spine x series, events joined by day, each column filled forward."""
    first = carry_from or start
    return f"""{events(cal)},
spine as (select cast(x as date) d from generate_series(timestamp '{first}', timestamp '{end}', interval 1 day) t(x)),
grid as (select s.series, spine.d from (select distinct series from {cal}) s cross join spine),
filled as (
  select grid.series, grid.d as_of_date,
         last_value(ev.value ignore nulls) over w as value,
         last_value(ev.ref_period ignore nulls) over w as ref_period,
         last_value(ev.available_date ignore nulls) over w as seen
  from grid left join ev on ev.series = grid.series and ev.available_date = grid.d
  window w as (partition by grid.series order by grid.d rows between unbounded preceding and current row)),
panel as (
  select series, as_of_date, value, ref_period, cast(as_of_date - seen as double) age_days,
         cast(coalesce(seen = as_of_date, false) as tinyint) is_new_release
  from filled where as_of_date >= date '{start}')"""


PANEL = f"{BASE}, {panel_from('cal', '1995-01-01', '2001-12-31')}"

LEVELS = """levels as (
  select series, ref_period, value from (
    select *, row_number() over (partition by series, ref_period order by as_of_date desc) rn
    from panel where value is not null and ref_period is not null) where rn = 1),
changed as (
  select l.series, l.ref_period, l.value,
         case meta.transform
           when 'level' then l.value when '' then l.value
           when 'diff' then l.value - lag(l.value) over w
           when 'mom' then l.value / nullif(lag(l.value) over w, 0) - 1
           when 'log_diff' then ln(case when l.value > 0 then l.value end) - lag(ln(case when l.value > 0 then l.value end)) over w end feature
  from levels l join meta on meta.series = l.series
  window w as (partition by l.series order by l.ref_period))"""

FEATS = f"""{PANEL}, {LEVELS},
feats as (
  select p.series, p.as_of_date, p.ref_period, p.value, c.feature
  from panel p left join changed c on c.series = p.series and c.ref_period = p.ref_period)"""

NAMES = ("order_value", "order_count", "ship_quantity", "discount_level", "urgent_orders")


def release(rp: str) -> str:
    return f"cast({rp} + interval 3 months - interval 1 day + interval 27 days as date)"


def sticky(d: str) -> str:
    q = f"cast(date_trunc('quarter', {d}) as date)"
    return f"case when {d} <= cast({q} - interval 1 day + interval 27 days as date) then cast({q} - interval 3 months as date) else {q} end"


def joined(names: tuple[str, ...]) -> str:
    xs = "".join(f", f_{n}.feature x_{n}" for n in names)
    joins = "".join(f" left join feats f_{n} on f_{n}.as_of_date = t.as_of_date and f_{n}.series = '{n}'" for n in names)
    return f"select t.as_of_date origin_date, t.ref_period target_ref_period, t.value y{xs} from feats t{joins} where t.series = 'revenue_growth'"


DS = f"""{FEATS},
wide as ({joined(NAMES)}),
ds as (
  select target_ref_period, {release('target_ref_period')} target_release_date, model_target_ref_period,
         {release('model_target_ref_period')} model_target_release_date, y, origin_date, {', '.join('x_' + n for n in NAMES)}
  from (select *, {sticky('origin_date')} model_target_ref_period from wide))"""


def rounded(cols: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 as {c.split('.')[-1]}" for c in cols.split())


# -- configuration, scans, dates --------------------------------------------------------------------------

ORACLES["series_meta"] = f"with {META} select series, name, code, freq, transform, cast(release_lag_days as int) release_lag_days, revision_type, vintage_source, vintage_mode, missing_policy from meta"
ORACLES["raw_vintage_scan"] = f"{RAW} where series = 'order_value'"
ORACLES["raw_final_scan"] = f"{RAW} where series = 'urgent_orders'"
ORACLES["raw_union_all"] = RAW
ORACLES["series_filter"] = f"{RAW} where series in ('order_value', 'urgent_orders')"

DAYS = "days as (select distinct cast(o_orderdate as date) d from orders)"
FREQ_DAYS = f"with {DAYS}, fd as (select d, freq from days cross join (values ('Q'), ('M'), ('W'), ('D')) f(freq))"
PERIOD_END = "case freq when 'Q' then cast(date_trunc('quarter', d) + interval 3 months - interval 1 day as date) when 'M' then last_day(d) else d end"
ORACLES["period_end_all_freqs"] = f"{FREQ_DAYS} select d, freq, {PERIOD_END} period_end from fd"
ORACLES["release_date_calc"] = f"{FREQ_DAYS} select d, freq, cast({PERIOD_END} + interval 27 days as date) release_date from fd"
ORACLES["available_date_strict"] = f"{BASE} select series, ref_period, vintage_date, release_date, case when vintage_date > release_date then vintage_date else release_date end available_date from cal"
ORACLES["calendar_one_series"] = f"{BASE} select * from cal where series = 'order_value'"
ORACLES["calendar_all_series"] = f"{BASE} select * from cal"
ORACLES["quarter_bounds"] = f"""with {DAYS} select d, q q_start, cast(q + interval 3 months - interval 1 day as date) q_end, cast(q - interval 3 months as date) q_before, cast(q + interval 6 months as date) q_after_next
from (select d, cast(date_trunc('quarter', d) as date) q from days)"""
ORACLES["sticky_target_quarter"] = f"with {DAYS} select d, {sticky('d')} model_target from days"
ORACLES["target_release_proxy"] = f"with {DAYS} select d, case when day(d) > 3 then {release('''date_trunc('quarter', d)''')} end \"release\" from days"
ORACLES["date_spine"] = "select cast(x as date) d from (select cast(min(o_orderdate) as date) lo, cast(max(o_orderdate) as date) hi from orders), lateral (select unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 1 day)) x)"
ORACLES["panel_range"] = f"{PANEL} select min(as_of_date) start_date, max(as_of_date) end_date from panel"

# -- panels -----------------------------------------------------------------------------------------------

ORACLES["headline_events"] = f"{BASE}, {events()} select * from ev"
ORACLES["daily_asof_panel"] = f"{PANEL} select * from panel"
ORACLES["panel_from_raw"] = ORACLES["daily_asof_panel"]
ORACLES["panel_is_new"] = f"{PANEL} select series, count(*) releases, min(as_of_date) first_release, max(as_of_date) last_release from panel where is_new_release = 1 group by series"
ORACLES["panel_age_days"] = f"{PANEL} select series, max(age_days) oldest, sum(age_days) total_age, count(age_days) days_seen, count(*) \"days\" from panel group by series"
ORACLES["series_panel"] = f"{PANEL} select * from panel where series = 'order_value'"
ALL = sorted((*NAMES, "revenue_growth"))
for key, column in (("panel_value_wide", "value"), ("panel_ref_wide", "ref_period"), ("panel_age_wide", "age_days"), ("panel_new_wide", "is_new_release")):
    picks = ", ".join(f"max(case when series = '{s}' then {column} end) {s}" for s in ALL)
    ORACLES[key] = f"{PANEL} select as_of_date, {picks} from panel group by as_of_date"
ORACLES["panel_carry_in"] = f"{BASE}, {panel_from('cal', '1997-03-05', '1997-12-31', '1990-01-01')} select * from panel"


def known_by(day: str, name: str = "known") -> str:
    """The vintages dated up to a day."""
    return f"{name} as (select * from cal where vintage_date is null or vintage_date <= date '{day}')"


ORACLES["panel_as_of"] = f"{BASE}, {known_by('1999-06-30')}, {panel_from('known', '1995-01-01', '1999-06-30')} select * from panel"
AS_OFS = ("1996-01-15", "1997-02-14", "1998-07-31", "1999-06-30", "2000-12-24", "2002-03-01")
ORACLES["panels_as_of"] = " union all ".join(f"select date '{a}' as_of, * from ({BASE}, {known_by(a)}, {panel_from('known', '1995-01-01', min(a, '2001-12-31'))} select * from panel)" for a in AS_OFS)
ORACLES["real_time_features"] = f"""{BASE},
days as (select cast(x as date) d from generate_series(timestamp '1995-01-01', timestamp '2001-12-31', interval 1 day) t(x)),
seen as (
  select d, series, ref_period, available_date, value from (
    select d, c.*, row_number() over (partition by d, series, ref_period order by vintage_date desc nulls last) rn
    from days join cal c on c.available_date <= d and c.available_date >= date '1995-01-01' and (c.vintage_date is null or c.vintage_date <= d)) where rn = 1),
moved as (
  select s.*, row_number() over (partition by d, s.series order by available_date desc, ref_period desc) newest,
         case meta.transform
           when 'level' then value when '' then value
           when 'diff' then value - lag(value) over w
           when 'mom' then value / nullif(lag(value) over w, 0) - 1
           when 'log_diff' then ln(case when value > 0 then value end) - lag(ln(case when value > 0 then value end)) over w end feature
  from seen s join meta on meta.series = s.series window w as (partition by d, s.series order by ref_period))
select g.series, g.d as_of_date, m.ref_period, round(m.value, 6) + 0.0 as value, round(m.feature, 6) + 0.0 feature
from (select d, series from days cross join (select distinct series from cal)) g
left join moved m on m.d = g.d and m.series = g.series and m.newest = 1"""
MODES = """moded as (
  select * exclude (available_date, lo, hi),
         case when series = 'order_value' and vintage_date > available_date then vintage_date else available_date end available_date
  from (select *, row_number() over (partition by series, ref_period order by vintage_date nulls first) lo,
               row_number() over (partition by series, ref_period order by vintage_date desc nulls last) hi from cal)
  where case series when 'revenue_growth' then lo = 1 when 'order_count' then hi = 1 else true end)"""
ORACLES["panel_vintage_modes"] = f"{BASE}, {MODES}, {panel_from('moded', '1995-01-01', '2001-12-31')} select * from panel"
STRICT = "late as (select * exclude (available_date), case when vintage_date > release_date then vintage_date else release_date end available_date from cal)"
ORACLES["panel_strict"] = f"{BASE}, {STRICT}, {panel_from('late', '1995-01-01', '2001-12-31')} select * from panel"
ORACLES["panel_jagged_edge"] = ORACLES["panel_strict"]
FIRST = "firsts as (select * exclude (rn) from (select *, row_number() over (partition by series, ref_period order by vintage_date nulls first) rn from cal) where rn = 1)"
ORACLES["panel_first_release"] = f"{BASE}, {FIRST}, {panel_from('firsts', '1995-01-01', '2001-12-31')} select * from panel"
ORACLES["panel_missing_policy"] = f"""{PANEL},
pol(series, policy) as (values ('revenue_growth', 'skip'), ('order_value', 'carry_forward'), ('order_count', 'zero'), ('ship_quantity', 'flag_only'), ('discount_level', 'skip'), ('urgent_orders', 'zero')),
x as (select p.*, policy, coalesce(value is null or age_days > 20, true) gone from panel p join pol using (series))
select series, as_of_date, case when not gone or policy = 'carry_forward' then value when policy = 'zero' then 0.0 end as value,
       ref_period, age_days, is_new_release, cast(gone as tinyint) is_missing from x"""
ORACLES["panel_derived_features"] = f"""{PANEL}
select series, as_of_date, cast(value is null as tinyint) missing, round(coalesce(pow(0.5, age_days / 30.0), 0.0), 6) + 0.0 freshness,
       round(case when is_new_release = 1 then value - lag(value) over (partition by series order by as_of_date) end, 6) + 0.0 news from panel"""
ORACLES["event_type_panel"] = f"""with daily as (
  select event_type series, cast(ts as date) ref_period, cast(sum(cast(value as decimal(18,4))) as double) as value from events group by 1, 2),
cal as (select series, ref_period, cast(null as date) vintage_date, value, cast(ref_period + interval 1 day as date) available_date from daily),
{panel_from('cal', '2024-01-01', '2024-02-15')} select * from panel"""

# -- features and dataset ---------------------------------------------------------------------------------

ORACLES["ref_level_compress"] = f"{PANEL}, {LEVELS} select * from levels"
for key, series in (("feat_level", "discount_level"), ("feat_diff", "order_count"), ("feat_mom", "order_value"), ("feat_log_diff", "urgent_orders")):
    ORACLES[key] = f"{PANEL}, {LEVELS} select ref_period, {rounded('feature')} from changed where series = '{series}'"
ORACLES["feat_map_back"] = f"{FEATS} select as_of_date, ref_period, {rounded('feature')} from feats where series = 'order_count'"
ORACLES["features_daily"] = f"{FEATS} select series, as_of_date, ref_period, {rounded('value feature')} from feats"
DS_KEYS = "target_ref_period, target_release_date, model_target_ref_period, model_target_release_date, origin_date"
X_NAMES = " ".join("x_" + n for n in NAMES)
ORACLES["bridge_dataset"] = f"{DS} select {DS_KEYS}, {rounded('y ' + X_NAMES)} from ds"
ORACLES["bridge_dataset_filtered"] = f"""{DS} select {DS_KEYS}, {rounded('y x_order_value x_discount_level')} from ds
where x_order_value is not null and x_discount_level is not null and y is not null and origin_date < model_target_release_date"""

TARGETS = """targets as (
  select ref_period, release_date, value as y from (
    select *, row_number() over (partition by ref_period order by release_date, vintage_date) rn
    from cal where series = 'revenue_growth' and ref_period is not null and release_date is not null and value is not null) where rn = 1)"""
ORACLES["bridge_dataset_model_target"] = f"""{DS}, {TARGETS},
own as (select w.origin_date, w.target_ref_period, cast(date_trunc('quarter', w.origin_date) as date) mt, w.x_order_value from wide w)
select target_ref_period, {release('target_ref_period')} target_release_date, mt model_target_ref_period, {release('mt')} model_target_release_date,
       round(t.y, 6) + 0.0 y, origin_date, {rounded('x_order_value')} from own left join targets t on t.ref_period = mt"""
ORACLES["feature_nonnull_ratio"] = f"{DS} " + " union all ".join(f"select 'x_{n}' feature, round(avg(cast(x_{n} is not null as int)), 6) + 0.0 ratio from ds" for n in NAMES)

# -- walk-forward training --------------------------------------------------------------------------------


def refits(start: str) -> str:
    return f"""refits as (
  select r refit_date, coalesce(lead(r) over (order by r), cast((select max(origin_date) from ds) + interval 1 day as date)) next_refit from (
    select date '{start}' r union
    select cast(x as date) from generate_series(timestamp '1990-01-01', timestamp '2001-12-01', interval 1 month) t(x) where x >= timestamp '{start}'))"""


MID, MONTHLY = f"{DS}, {refits('1998-01-15')}", f"{DS}, {refits('1998-01-01')}"
TRAIN = "train as (select r.refit_date, d.* from refits r join ds d on d.origin_date >= r.refit_date - interval 3 years and d.origin_date < r.refit_date and d.y is not null)"
ORACLES["refit_schedule"] = f"{MID} select * from refits"
ORACLES["train_window_stats"] = f"""{MID}, {TRAIN}
select r.refit_date, count(y) n_rows, count(case when x_order_value is not null then y end) n,
       round(sum(x_order_value), 6) + 0.0 sum_x, round(sum(case when x_order_value is not null then y end), 6) + 0.0 sum_y, round(sum(x_order_value * y), 6) + 0.0 sum_xy
from refits r left join train t on t.refit_date = r.refit_date group by 1"""
COMPLETE = " and ".join(f"x_{n} is not null" for n in NAMES)
ORACLES["eligible_refits"] = f"""{DS}, {refits('1995-03-10')}, {TRAIN},
st as (select r.refit_date, r.next_refit, count(t.y) n_rows, count(case when {COMPLETE} then 1 end) n_complete,
       least({', '.join(f'count(distinct x_{n})' for n in NAMES)}) variety
       from refits r left join train t on t.refit_date = r.refit_date group by 1, 2)
select refit_date, next_refit, n_rows, n_complete,
       case when n_rows < 200 then 'too few rows' when n_complete = 0 then 'no complete rows' when variety < 2 then 'a feature does not vary' else 'ok' end reason from st"""
ORACLES["zscore_params"] = f"""{MID}, {TRAIN}
select refit_date, count(y) n_rows, round(avg(x_order_value), 6) + 0.0 mu_x_order_value, round(nullif(stddev_pop(x_order_value), 0), 6) + 0.0 sd_x_order_value,
       round(avg(x_discount_level), 6) + 0.0 mu_x_discount_level, round(nullif(stddev_pop(x_discount_level), 0), 6) + 0.0 sd_x_discount_level
from train group by 1 having count(y) >= 200"""
ORACLES["zscore_apply"] = f"""{MONTHLY}, {TRAIN},
zp as (select refit_date, avg(x_order_value) m1, nullif(stddev_pop(x_order_value), 0) s1, avg(x_discount_level) m2, nullif(stddev_pop(x_discount_level), 0) s2 from train group by 1 having count(y) >= 200)
select d.origin_date, r.refit_date, round((x_order_value - m1) / s1, 5) + 0.0 z_x_order_value, round((x_discount_level - m2) / s2, 5) + 0.0 z_x_discount_level
from ds d join refits r on d.origin_date >= r.refit_date and d.origin_date < r.next_refit join zp on zp.refit_date = r.refit_date"""

ONE = """one as (
  select refit_date, count(*) n_rows, count(case when x_order_value is not null then 1 end) n,
         regr_intercept(y, x_order_value) b_0, regr_slope(y, x_order_value) b_1 from train group by 1 having count(*) >= 200)"""
ORACLES["ols_single_feature"] = f"{MID}, {TRAIN}, {ONE} select refit_date, n_rows, n, {rounded('b_0 b_1', 5)} from one"
ORACLES["ols_two_feature"] = f"""{MONTHLY}, {TRAIN},
c as (select refit_date, count(*) n_rows, count(case when x_order_value is not null and x_order_count is not null then 1 end) n,
  covar_pop(u, u) s11, covar_pop(v, v) s22, covar_pop(u, v) s12, covar_pop(u, w) s1y, covar_pop(v, w) s2y, avg(u) mu, avg(v) mv, avg(w) mw
  from (select *, case when ok then x_order_value end u, case when ok then x_order_count end v, case when ok then y end w
        from (select *, x_order_value is not null and x_order_count is not null ok from train)) group by 1 having count(*) >= 200),
b as (select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) b_1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) b_2 from c)
select refit_date, n_rows, n, round(mw - b_1 * mu - b_2 * mv, 5) + 0.0 b_0, {rounded('b_1 b_2', 5)} from b"""


def elimination(k: int, source: str) -> str:
    """Gauss-Jordan on the centred moments a_i_j (j = k: the target), a CTE for each pivot."""
    steps, before = [], source
    for p in range(k):
        cells = []
        for i in range(k):
            for j in range(k + 1):
                row = f"a_{p}_{j} / a_{p}_{p}"
                cells.append(f"{row if i == p else f'a_{i}_{j} - a_{i}_{p} * ({row})'} a_{i}_{j}")
        means = ", ".join(f"m_{i}" for i in range(k + 1))
        steps.append(f"e{p} as (select refit_date, n_rows, n, {means}, {', '.join(cells)} from {before})")
        before = f"e{p}"
    intercept = f"m_{k}" + "".join(f" - a_{i}_{k} * m_{i}" for i in range(k))
    return ", ".join(steps) + f", full_fit as (select refit_date, n_rows, n, {intercept} b_0, {', '.join(f'a_{i}_{k} b_{i + 1}' for i in range(k))} from {before})"


K = len(NAMES)
SIDES = [*(f"x_{n}" for n in NAMES), "y"]
FULL = f"""rows_full as (select *, {COMPLETE} ok from train),
mean_full as (select refit_date, count(*) n_rows, count(case when ok then 1 end) n, {', '.join(f'avg(case when ok then {c} end) m_{i}' for i, c in enumerate(SIDES))} from rows_full group by 1 having count(*) >= 200),
centred as (select m.refit_date, any_value(m.n_rows) n_rows, any_value(m.n) n, {', '.join(f'any_value(m_{i}) m_{i}' for i in range(K + 1))},
  {', '.join(f'sum((r.{SIDES[i]} - m_{i}) * (r.{SIDES[j]} - m_{j})) a_{i}_{j}' for i in range(K) for j in range(K + 1))}
  from mean_full m join rows_full r on r.refit_date = m.refit_date and r.ok group by 1),
{elimination(K, 'centred')}"""
BS = " ".join(f"b_{i}" for i in range(K + 1))
ORACLES["ols_full"] = f"{MONTHLY}, {TRAIN}, {FULL} select refit_date, n_rows, n, {rounded(BS, 4)} from full_fit"

ORACLES["oos_assignment"] = f"{MID} select d.origin_date, r.refit_date from ds d join refits r on d.origin_date >= r.refit_date and d.origin_date < r.next_refit"
STAGE = "case when {0} >= 61 then 'early' when {0} >= 21 then 'mid' when {0} is not null then 'late' else 'unknown' end"
GAP = "(d.model_target_release_date - d.origin_date)"
ORACLES["distance_bucket_trainer"] = f"{DS} select origin_date, {STAGE.format(GAP)} distance_bucket from ds d"


def predicted(fit: str, formula: str) -> str:
    """In-sample residual spreads, out-of-sample rows and intervals of a fit."""
    return f"""resid as (select t.refit_date, {STAGE.format('(t.model_target_release_date - t.origin_date)')} b, {formula.replace('d.', 't.')} - t.y err from train t join {fit} f on f.refit_date = t.refit_date),
by_stage as (select refit_date, b, stddev_pop(err) sigma from resid where err is not null group by 1, 2 having stddev_pop(err) > 0),
by_refit as (select refit_date, stddev_pop(err) sigma from resid where err is not null group by 1),
oos as (
  select d.*, r.refit_date, {formula} y_hat, 'Bridge_simple_15y' model_name, {STAGE.format(GAP)} distance_bucket
  from ds d join refits r on d.origin_date >= r.refit_date and d.origin_date < r.next_refit join {fit} f on f.refit_date = r.refit_date),
preds as (
  select o.*, coalesce(s.sigma, g.sigma) nowcast_sigma, y_hat - 1.96 * coalesce(s.sigma, g.sigma) ci_low_95, y_hat + 1.96 * coalesce(s.sigma, g.sigma) ci_high_95
  from oos o left join by_stage s on s.refit_date = o.refit_date and s.b = o.distance_bucket left join by_refit g on g.refit_date = o.refit_date)"""


SINGLE = f"{MONTHLY}, {TRAIN}, {ONE}, {predicted('one', 'f.b_0 + f.b_1 * d.x_order_value')}"
ORACLES["stage_sigmas"] = f"{SINGLE} select refit_date, b distance_bucket, cast(0 as int) \"overall\", {rounded('sigma')} from by_stage union all select refit_date, null, 1, {rounded('sigma')} from by_refit"
ORACLES["oos_sigma"] = f"{SINGLE} select origin_date, distance_bucket, {rounded('nowcast_sigma')} from preds"
ORACLES["oos_ci"] = f"{SINGLE} select origin_date, {rounded('y_hat ci_low_95 ci_high_95', 5)} from preds"
ALL_X = "f.b_0" + "".join(f" + f.b_{i + 1} * d.x_{n}" for i, n in enumerate(NAMES))
ORACLES["bridge_oos_predictions"] = f"""{MONTHLY}, {TRAIN}, {FULL}, {predicted('full_fit', ALL_X)}
select origin_date, model_target_ref_period, model_target_release_date, model_name, distance_bucket, {rounded('y y_hat nowcast_sigma ci_low_95 ci_high_95', 4)} from preds"""
ORACLES["nowcast_clean"] = f"{SINGLE} select origin_date, {rounded('nowcast_gdp_growth nowcast_sigma ci_low_95 ci_high_95', 5)}, model_target_ref_period from (select *, y_hat nowcast_gdp_growth from preds)"

STAGED = f"""{MONTHLY}, {TRAIN}, {ONE},
own as (
  select refit_date, stage, n, b_0, b_1 from (
    select t.refit_date, {STAGE.format('(t.model_target_release_date - t.origin_date)')} stage, count(case when t.x_order_value is not null then 1 end) n,
           regr_intercept(t.y, t.x_order_value) b_0, regr_slope(t.y, t.x_order_value) b_1
    from train t join one on one.refit_date = t.refit_date group by 1, 2) where n >= 80 and stage <> 'unknown'),
staged as (
  select d.origin_date, d.y, {STAGE.format(GAP)} distance_bucket, o.b_0 is not null stage_model, 'Bridge_stage_aware_15y' model_name,
         case when o.b_0 is not null then o.b_0 + o.b_1 * d.x_order_value else f.b_0 + f.b_1 * d.x_order_value end y_hat
  from ds d join refits r on d.origin_date >= r.refit_date and d.origin_date < r.next_refit join one f on f.refit_date = r.refit_date
  left join own o on o.refit_date = r.refit_date and o.stage = {STAGE.format(GAP)})"""
ORACLES["stage_ols_coeffs"] = f"{STAGED} select refit_date, cast(null as varchar) stage, n, {rounded('b_0 b_1', 5)} from one union all select refit_date, stage, n, {rounded('b_0 b_1', 5)} from own"
ORACLES["stage_ols_predict"] = f"{STAGED} select origin_date, distance_bucket, stage_model, {rounded('y_hat', 5)} from staged"

FULL_STAGED = f"""{MONTHLY}, {TRAIN}, {FULL}"""
ORACLES["stage_sigmas_full"] = f"{FULL_STAGED}, {predicted('full_fit', ALL_X)} select refit_date, b distance_bucket, cast(0 as int) \"overall\", {rounded('sigma', 4)} from by_stage union all select refit_date, null, 1, {rounded('sigma', 4)} from by_refit"


def _per_stage() -> str:
    """The same elimination for each refit and stage, by a key made of both."""
    keyed = f"strain as (select * exclude (refit_date), refit_date || {STAGE.format('(t.model_target_release_date - t.origin_date)')} refit_date from train t)"
    own = FULL.replace("from train)", "from strain)").replace("having count(*) >= 200", "having count(*) >= 80")
    for name in ("rows_full", "mean_full", "centred", "full_fit", *(f"e{p}" for p in range(K))):
        own = own.replace(f"{name} as", f"s_{name} as").replace(f"from {name}", f"from s_{name}").replace(f"join {name}", f"join s_{name}")
    return f"{keyed}, {own}"


ORACLES["stage_ols_full"] = f"""{FULL_STAGED}, {_per_stage()},
own as (select * from s_full_fit where n >= 80 and refit_date not like '%unknown')
select d.origin_date, {STAGE.format(GAP)} distance_bucket, o.b_0 is not null stage_model,
       round(case when o.b_0 is not null then {ALL_X.replace('f.', 'o.')} else {ALL_X} end, 4) + 0.0 y_hat
from ds d join refits r on d.origin_date >= r.refit_date and d.origin_date < r.next_refit join full_fit f on f.refit_date = r.refit_date
left join own o on o.refit_date = r.refit_date || {STAGE.format(GAP)}"""

# -- autoregression ---------------------------------------------------------------------------------------

AR = f"""{BASE}, {TARGETS},
hist as (
  select t.ref_period t_eval, h.ref_period, h.y, lag(h.y) over w y1, lag(h.y, 2) over w y2
  from targets t join targets h on h.release_date < t.ref_period and h.ref_period >= t.ref_period - interval 3 years
  where t.ref_period >= date '1998-01-01' window w as (partition by t.ref_period order by h.ref_period)),
ar1 as (
  select t_eval, count(*) n_train, min(ref_period) train_start, max(ref_period) train_end, regr_intercept(y, y1) c, regr_slope(y, y1) phi, arg_max(y, ref_period) newest
  from hist group by 1 having count(*) >= 8),
fc as (
  select t.ref_period target_ref_period, t.release_date target_release_date, t.y, c + phi * newest y_hat, c + phi * (c + phi * newest) y_hat2,
         date_diff('month', train_end, t.ref_period) / 3 steps, train_start, train_end, 'AR_p1_15y' model_name
  from targets t left join ar1 on ar1.t_eval = t.ref_period where t.ref_period >= date '1998-01-01'),
daily as (
  select model_name, cast(x as date) origin_date, target_ref_period, target_release_date, cast(target_release_date - cast(x as date) as int) distance_to_release, y, y_hat, train_start, train_end
  from fc, lateral (select unnest(generate_series(cast(target_ref_period as timestamp), target_ref_period + interval 3 months - interval 1 day, interval 1 day)) x)
  where cast(x as date) < target_release_date)"""
ORACLES["quarterly_targets"] = f"{BASE}, {TARGETS} select * from targets"
ORACLES["ar1_coeffs"] = f"{AR} select t_eval, n_train, train_start, train_end, {rounded('c phi')} from ar1"
FC_KEYS = "target_ref_period, target_release_date, train_start, train_end, model_name"
ORACLES["ar1_quarterly"] = f"{AR} select {FC_KEYS}, {rounded('y y_hat')} from fc"
ORACLES["ar1_true_horizon"] = f"{AR} select {FC_KEYS}, round(y, 6) + 0.0 y, round(case when steps <= 1 then y_hat when steps = 2 then y_hat2 end, 6) + 0.0 y_hat from fc"
ORACLES["ar2_quarterly"] = f"""{AR},
c2 as (select t_eval, covar_pop(u, u) s11, covar_pop(v, v) s22, covar_pop(u, v) s12, covar_pop(u, w) s1y, covar_pop(v, w) s2y, avg(u) mu, avg(v) mv, avg(w) mw
  from (select t_eval, case when y2 is not null then y1 end u, y2 v, case when y2 is not null then y end w from hist) group by 1),
b2 as (select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) p1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) p2 from c2),
last2 as (select t_eval, arg_max(y, ref_period) z0, arg_max(y1, ref_period) z1 from hist group by 1)
select {FC_KEYS.replace(', model_name', '')}, 'AR_p2' model_name, round(y, 5) + 0.0 y, round(case when train_end is not null then mw - p1 * mu - p2 * mv + p1 * z0 + p2 * z1 end, 5) + 0.0 y_hat
from fc left join b2 on b2.t_eval = target_ref_period left join last2 on last2.t_eval = target_ref_period"""
ORACLES["ar1_by_nation"] = """with q as (
  select c_nationkey k, cast(date_trunc('quarter', o_orderdate) as date) rp, cast(sum(cast(o_totalprice as decimal(18,2))) as double) s
  from orders join customer on c_custkey = o_custkey group by 1, 2),
t as (
  select k, rp, cast(rp + interval 3 months - interval 1 day + interval 27 days as date) rel, y
  from (select *, 100 * (s / lag(s) over (partition by k order by rp) - 1) y from q) where y is not null),
h as (
  select a.k, a.rp t, b.rp, b.y, lag(b.y) over (partition by a.k, a.rp order by b.rp) y1
  from t a join t b on a.k = b.k and b.rel < a.rp and b.rp >= a.rp - interval 3 years where a.rp >= date '1998-01-01'),
f as (select k, t, min(rp) train_start, max(rp) train_end, regr_intercept(y, y1) c, regr_slope(y, y1) phi, arg_max(y, rp) z from h group by 1, 2 having count(*) >= 8)
select t.k c_nationkey, t.rp target_ref_period, rel target_release_date, round(y, 4) + 0.0 y, round(c + phi * z, 4) + 0.0 y_hat, train_start, train_end, 'AR_p1_15y' model_name
from t left join f on f.k = t.k and f.t = t.rp where t.rp >= date '1998-01-01'"""
ORACLES["ar1_daily"] = f"{AR} select * exclude (y, y_hat), {rounded('y y_hat')} from daily"

# -- evaluation -------------------------------------------------------------------------------------------


def metric(places: int = 6) -> str:
    hit = "cast(case when y_hat is null or y is null then null when sign(y) = sign(y_hat) then 1 else 0 end as double)"
    return f"""count(y_hat - y) n_obs, round(sqrt(avg((y_hat - y) * (y_hat - y))), {places}) + 0.0 rmse, round(avg(abs(y_hat - y)), {places}) + 0.0 mae,
       round(avg(y_hat - y), {places}) + 0.0 bias, round(avg({hit}), {places}) + 0.0 hit_rate"""


EVAL_BUCKET = "case when {0} >= 60 then 'early' when {0} between 30 and 59 then 'mid' when {0} between 10 and 29 then 'late' when {0} between 0 and 9 then 'final' else 'unknown' end"
ORACLES["metrics_overall"] = f"{AR} select {metric()} from daily"
ORACLES["metrics_by_model"] = f"""{AR} select model_name, {metric()},
  round(1 - sum((y_hat - y) * (y_hat - y)) / nullif(sum(case when y_hat is not null then (y - my) * (y - my) end), 0), 6) + 0.0 r2
  from (select *, avg(case when y_hat is not null then y end) over (partition by model_name) my from daily) group by 1"""
ORACLES["metrics_by_distance"] = f"{AR} select model_name, {EVAL_BUCKET.format('distance_to_release')} distance_bucket, {metric()} from daily group by 1, 2"
SPANS = "spans(time_slice, lo, hi) as (values ('1998', date '1998-01-01', date '1998-12-31'), ('1999', date '1999-01-01', date '1999-12-31'), ('2000_plus', date '2000-01-01', null))"
ORACLES["metrics_by_time_slice"] = f"{AR}, {SPANS} select model_name, time_slice, {metric()} from daily join spans on origin_date >= lo and (hi is null or origin_date <= hi) group by 1, 2"
ORACLES["distance_bucket_eval"] = f"select cast(d as int) d, {EVAL_BUCKET.format('d')} distance_bucket from range(-5, 131) t(d)"
YEAR_SLICE = "case when year({0}) between 2010 and 2014 then '2010_2014' when year({0}) between 2015 and 2019 then '2015_2019' when year({0}) between 2020 and 2022 then '2020_2022' else '2023_plus' end"
ORACLES["time_slice_label"] = f"select d, {YEAR_SLICE.format('d')} time_slice from (select cast(x as date) d from generate_series(timestamp '2005-06-01', timestamp '2024-06-01', interval 1 day) t(x))"


def slices(source: str) -> str:
    return f"""select model_name, 'overall' slice_type, 'overall' slice, {metric(5)} from {source} group by 1
union all select model_name, 'time_slice', {YEAR_SLICE.format('origin_date')}, {metric(5)} from {source} group by 1, 3
union all select model_name, 'distance_bucket', distance_bucket, {metric(5)} from {source} group by 1, 3"""


ORACLES["bridge_metrics_sets"] = f"{SINGLE} {slices('preds')}"
ORACLES["cmp_standardize"] = f"{AR} select 'UNKNOWN' model_name, count(y_hat - y) n_obs, round(sqrt(avg((y_hat - y) * (y_hat - y))), 6) + 0.0 rmse, cast(null as double) mae, cast(null as double) bias, cast(null as double) hit_rate from daily"
# Both chains of CTEs begin alike; the second continues the first.
ORACLES["model_compare"] = f"""{STAGED}, {predicted('one', 'f.b_0 + f.b_1 * d.x_order_value')}, {AR[len(BASE) + 2:]}, {SPANS},
both_models as (select model_name, origin_date, distance_bucket, y, y_hat from preds union all select model_name, origin_date, distance_bucket, y, y_hat from staged)
{slices('both_models')}
union all select model_name, 'overall', 'overall', {metric(5)} from daily group by 1
union all select model_name, 'distance_bucket', {EVAL_BUCKET.format('distance_to_release')}, {metric(5)} from daily group by 1, 3
union all select model_name, 'time_slice', time_slice, {metric(5)} from daily join spans on origin_date >= lo and (hi is null or origin_date <= hi) group by 1, 3"""

# -- diagnostics ------------------------------------------------------------------------------------------

ORACLES["available_range"] = f"{BASE} select cast(min(available_date) - interval 30 days as date) start_date, cast(max(available_date) + interval 30 days as date) end_date from cal"
ORACLES["samples_per_quarter"] = f"{DS} select target_ref_period, count(*) samples from ds group by 1"
KNOWN = " + ".join(f"cast(x_{n} is not null as int)" for n in NAMES)
ORACLES["quarter_thirds_density"] = f"""{DS},
placed as (select target_ref_period, {KNOWN} known, row_number() over (partition by target_ref_period order by origin_date) - 1 pos, count(*) over (partition by target_ref_period) n from ds where target_ref_period is not null)
select target_ref_period, case when pos < n // 3 then 'early' when pos < (2 * n) // 3 then 'mid' else 'late' end segment, count(*) n_rows, round(avg(known), 6) + 0.0 mean_known, round(median(known), 6) + 0.0 median_known
from placed group by 1, 2"""
ORACLES["date_slice_10d"] = f"{DS} select {DS_KEYS}, {rounded('y ' + X_NAMES)} from ds where origin_date between date '2000-03-01' and date '2000-03-10'"
COVER = " union all ".join(f"select 'x_{n}' feature, year(origin_date) // 10 * 10 d, count(x_{n}) known, count(*) total from ds group by 2" for n in NAMES)
ORACLES["feature_coverage_decade"] = f"""{DS}, cover as ({COVER}),
spots as (select 'x_' || n feature, d from (values {', '.join(f"('{n}')" for n in NAMES)}) a(n) cross join (values (1980), (1990), (2000), (2010), (2020)) b(d))
select s.feature, s.d || 's' as "decade", round(known / nullif(total, 0)::double, 6) + 0.0 coverage_ratio, coalesce(known, 0) non_missing_count, coalesce(total, 0) total_count
from spots s left join cover c on c.feature = s.feature and c.d = s.d"""
ORACLES["calendar_violations"] = f"""{BASE} select series, count(*) n_rows, count(*) filter (where available_date < release_date) before_release, count(*) filter (where available_date < vintage_date) before_vintage,
  count(*) filter (where release_date < period_end) before_period_end, min(available_date) first_available, max(available_date) last_available from cal group by 1"""
ORACLES["raw_profile"] = f"""{BASE} select series, count(*) n_rows, min(ref_period) first_ref, max(ref_period) last_ref, count(value) n_values, round(avg(value), 5) + 0.0 mean, round(stddev_samp(value), 5) + 0.0 sd,
  round(min(value), 5) + 0.0 lowest, round(quantile_cont(value, 0.25), 5) + 0.0 q25, round(quantile_cont(value, 0.5), 5) + 0.0 q50, round(quantile_cont(value, 0.75), 5) + 0.0 q75, round(max(value), 5) + 0.0 highest from cal group by 1"""
ORACLES["raw_integrity"] = f"""{BASE} select series, cast(count(*) as bigint) n_rows, count(*) filter (where ref_period is null) null_periods, count(*) filter (where value is null) null_values,
  cast(count(*) - count(distinct (ref_period, vintage_date)) as bigint) repeats, series <> 'urgent_orders' configured,
  series <> 'urgent_orders' and count(*) filter (where ref_period is null or value is null) = 0 and count(*) = count(distinct (ref_period, vintage_date)) ok from cal group by 1"""

ORACLES["raw_structure"] = f"""{BASE},
per as (
  select c.series, c.ref_period, meta.freq, min(vintage_date) fv, count(distinct vintage_date) vs, count(*) filter (where vintage_date < period_end) early
  from cal c join meta on meta.series = c.series group by 1, 2, 3),
step as (
  select *, lag(ref_period) over w prev, lag(fv) over w older,
         case freq when 'Q' then date_diff('quarter', lag(ref_period) over w, ref_period) when 'M' then date_diff('month', lag(ref_period) over w, ref_period)
                   when 'W' then date_diff('day', lag(ref_period) over w, ref_period) // 7 else date_diff('day', lag(ref_period) over w, ref_period) end - 1 gap
  from per window w as (partition by series order by ref_period)),
sums as (
  select series, count(*) n_periods, cast(coalesce(sum(gap) filter (where gap > 0), 0) as bigint) missing_periods,
         min(case when gap > 0 then cast(prev + case freq when 'Q' then interval 3 months when 'M' then interval 1 month when 'W' then interval 7 days else interval 1 day end as date) end) first_missing,
         max(case when gap > 0 then cast(ref_period - case freq when 'Q' then interval 3 months when 'M' then interval 1 month when 'W' then interval 7 days else interval 1 day end as date) end) last_missing,
         cast(sum(early) as bigint) early_vintages, count(*) filter (where fv < older) unordered_periods,
         count(*) filter (where vs > 1 and series = 'order_count') unexpected_revisions
  from step group by 1)
select *, missing_periods = 0 and early_vintages = 0 and unordered_periods = 0 and unexpected_revisions = 0 ok from sums"""
ORACLES["event_gaps"] = """with d as (select distinct event_type series, cast(ts as date) x from events where event_type is not null),
g as (select *, x - lag(x) over (partition by series order by x) - 1 gap, lag(x) over (partition by series order by x) p from d)
select series, count(*) n_periods, cast(coalesce(sum(gap), 0) as bigint) missing_periods, min(case when gap > 0 then p + 1 end) first_missing,
       max(case when gap > 0 then x - 1 end) last_missing, coalesce(sum(gap), 0) = 0 ok from g group by 1"""
ORACLES["event_value_quantiles"] = " union all ".join(f"select event_type, cast({p} as double) p, round(quantile_cont(value, {p}), 6) + 0.0 quantile from events where value is not null and not isnan(value) group by 1" for p in ("0.0", "0.01", "0.5", "0.99", "1.0"))
# -- results and signals ----------------------------------------------------------------------------------

COVERAGE = f"({KNOWN}) / 5.0"
ORACLES["nowcast_results"] = f"{SINGLE} select origin_date, model_target_ref_period target_quarter, round(y_hat, 5) + 0.0 point, round(nowcast_sigma, 5) + 0.0 std, distance_bucket stage, round(cast({COVERAGE} as double), 5) + 0.0 info_coverage, model_name from preds"
SIGNAL = "case when y_hat > 2.5 then 1 when y_hat < 0 then -1 when y_hat is not null then 0 end"
ORACLES["nowcast_signals"] = f"""{SINGLE} select origin_date, model_target_ref_period target_quarter, round(y_hat, 5) + 0.0 point, round(nowcast_sigma, 5) + 0.0 std, cast({SIGNAL} as int) signal,
  round(case when y_hat is null then null when nowcast_sigma > 0 then 1 - exp(-least(abs(y_hat - 2.5), abs(y_hat)) / nowcast_sigma) else 0.0 end, 5) + 0.0 confidence from preds"""
def ds_as_of(day: str) -> str:
    """The dataset from vintages dated up to a day, and up to that day."""
    known = DS.replace("from dated)", f"from dated where vintage_source <> 'alfred' or cast(period_end + (release_lag_days + 30 * vint) * interval 1 day as date) <= date '{day}')")
    return known.replace("timestamp '2001-12-31'", f"timestamp '{day}'")


ORACLES["datasets_as_of"] = " union all ".join(f"select date '{a}' as_of, target_ref_period, target_release_date, model_target_ref_period, model_target_release_date, origin_date, {rounded('y ' + X_NAMES)} from ({ds_as_of(a)} select * from ds)" for a in AS_OFS[1:4])
# The model of 1 May learns from what was known on 1 May, and meets what was known on 17 May.
ORACLES["run_daily"] = f"""with ds as (
  select * from ({ds_as_of('2000-05-01')} select * from ds) where origin_date < date '2000-05-01'
  union all by name select * from ({ds_as_of('2000-05-17')} select * from ds) where origin_date = date '2000-05-17'),
refits as (select date '2000-05-01' refit_date, date '2000-05-18' next_refit), {TRAIN}, {FULL}, {predicted('full_fit', ALL_X)}
select origin_date, model_target_ref_period target_quarter, round(y_hat, 4) + 0.0 point, round(nowcast_sigma, 4) + 0.0 std, cast({SIGNAL} as int) signal,
  round(case when y_hat is null then null when nowcast_sigma > 0 then 1 - exp(-least(abs(y_hat - 2.5), abs(y_hat)) / nowcast_sigma) else 0.0 end, 4) + 0.0 confidence
from preds where origin_date = date '2000-05-17'"""

#: However its rows came in, a day's nowcast is the same.
ORACLES["run_daily_from_state"] = ORACLES["run_daily"]
