"""Queries of exact and resampled tests and intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ethoflow.catalog import query
from ethoflow.operators import bouts, density, proportions, stats
from ethoflow.plans.frames import ANIMALS, FPS, SHARES
from ethoflow.plans.roles import FRAMES, K, frames, load, rounded

#: Ways to choose k of the ranks 1 to i with the sum s, for the exact laws.
WAYS = """ways(i, k, s, n) as (
  select 0, 0, 0, 1::hugeint
  union all
  select i + 1, k + t, s + t * (i + 1), sum(n)::hugeint from ways, (values (0), (1)) v(t) where i < 128 and k + t <= 8 group by all
)"""


def _tail(z: str) -> str:
    """Two-sided tail of the normal law, by Simpson's rule."""
    weight = "case when i in (0, 600) then 1 when i % 2 = 1 then 4 else 2 end"
    return f"greatest(0, 1 - 2 * ({z}) / 1800 * 0.3989422804014327 * list_sum([exp(-0.5 * pow(({z}) * i / 600, 2)) * ({weight}) for i in range(601)]))"


def _ranked(source: str) -> str:
    """From rows (key, g, v) to a row (key, group_a, group_b, n_a, n_b, u, ties) for each pair of groups."""
    return f"""s as ({source}), pairs as (
  select distinct a.key, a.g as group_a, b.g as group_b from s a join s b on a.key = b.key and a.g < b.g
), ranked as (
  select pairs.*, s.g = group_a as first, count(*) over same as t, rank() over (partition by pairs.key, group_a, group_b order by v) + (count(*) over same - 1) / 2.0::double as r
  from pairs join s on s.key = pairs.key and s.g in (group_a, group_b) window same as (partition by pairs.key, group_a, group_b, v)
), sums as (
  select key, group_a, group_b, count(*) filter (first) as n_a, count(*) filter (not first) as n_b,
    sum(r) filter (first) - count(*) filter (first) * (count(*) filter (first) + 1) / 2.0::double as u, sum(t * t - 1) as ties
  from ranked group by all
)"""


_EXACT = """exact_p as (
  select key, group_a, group_b, least(1, 2 * sum(n) filter (s - k * (k + 1) / 2 >= greatest(u, n_a * n_b - u))::double / sum(n)::double) as p
  from sums join ways on i = n_a + n_b and k = least(n_a, n_b) where ties = 0 and least(n_a, n_b) <= 8 group by all
)"""
_NORMAL = f"""normal_p as (
  select key, group_a, group_b, case when s2 <= 0 then 1 else {_tail("abs(abs(u - n_a * n_b / 2.0::double) - 0.5) / sqrt(s2)")} end as p, abs(u - n_a * n_b / 2.0::double) < 0.5 as inside
  from (select *, n_a * n_b / 12.0::double * (n_a + n_b + 1 - ties / greatest((n_a + n_b) * (n_a + n_b - 1), 1)::double) as s2 from sums) where ties > 0 or least(n_a, n_b) > 8
)"""


def _corrected(tests: str) -> str:
    """Benjamini-Hochberg within each key."""
    return f"""tests as ({tests}), steps as (
  select *, row_number() over (partition by key order by p) as step, count(*) over (partition by key) as m from tests
), corrected as (
  select *, greatest(p, least(1, min(p * m / step) over (partition by key order by step rows between current row and unbounded following))) as p_adj from steps
)"""


_RANK_TESTS = f"""{_EXACT}, {_NORMAL}, {_corrected("select sums.*, coalesce(e.p, case when n.inside then 1 else n.p end) as p from sums left join exact_p e using (key, group_a, group_b) left join normal_p n using (key, group_a, group_b)")}
select key, group_a, group_b, n_a, n_b, round(u, 6) as u, round(p, 6) as p, round(p_adj, 6) as p_adj from corrected"""
_SUPPLIERS = "select s_nationkey as key, (s_suppkey % 3)::varchar as g, s_acctbal as v from supplier"


@query(f"with recursive {WAYS}, {_ranked(_SUPPLIERS)}, {_RANK_TESTS}")
def rank_tests(spark, d):
    """Small groups of a nation's suppliers, without ties: the exact law."""
    s = load(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), (F.col("s_suppkey") % 3).alias("g"), "s_acctbal")
    return rounded(stats.rank_tests(s, "s_acctbal", "g", ("key",)).drop("sig", "significant"))


_SHARE_ROWS = "select cluster as key, grp::varchar as g, round(proportion, 9) as v from shares"


@query(f"with recursive {WAYS}, {SHARES.removeprefix('with ')}, {_ranked(_SHARE_ROWS)}, {_RANK_TESTS}")
def rank_tests_of_shares(spark, d):
    """Every cluster's shares between all pairs of groups, with ties: the normal law."""
    rows = proportions.long(proportions.wide(frames(spark, d), range(K))).select(F.col("cluster").cast("long").alias("key"), (F.col("trial_id") % 4).alias("g"), F.round("proportion", 9).alias("v"))
    return rounded(stats.rank_tests(rows, "v", "g", ("key",)).drop("sig", "significant"))


@query(f"""with recursive signs(i, s, n) as (
  select 0, 0, 1::hugeint union all select i + 1, s + t * (i + 1), sum(n)::hugeint from signs, (values (0), (1)) v(t) where i < 50 group by all
), s as (
  select s_nationkey as key, round(s_acctbal - 4000, 2) as d from supplier
), r as (
  select *, rank() over (partition by key order by abs(d)) as r, count(*) over (partition by key) as n from s
), w as (
  select key, any_value(n) as n, least(coalesce(sum(r) filter (d > 0), 0), coalesce(sum(r) filter (d < 0), 0)) as w from r where d <> 0 group by key
), e as (
  select key, least(1, 2 * sum(signs.n) filter (s <= w)::double / sum(signs.n)::double) as p from w join signs on i = w.n and w.n <= 50 group by key
)
select key, w.n, case when w.n < 3 then 'NaN'::double else w::double end as w,
  round(case when w.n < 3 then 'NaN'::double else coalesce(e.p, {_tail("abs(w - w.n * (w.n + 1) / 4.0::double) / sqrt(w.n * (w.n + 1) * (2 * w.n + 1) / 24.0::double)")}) end, 6) as p
from w left join e using (key)""")
def signed_rank_tests(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.round(F.col("s_acctbal") - 4000, 2).alias("d"))
    return rounded(stats.signed_rank_tests(s, "d", ("key",)))


# All relabellings of a nation's suppliers, as the bits of a number; the longest lists are those of the largest nation.
@query(f"""with recursive s as (
  select s_nationkey as key, s_suppkey % 2 as g, s_acctbal as v from supplier
), l as (
  select key, list(v order by g, v) as vs, count(*) filter (g = 0) as n_a, count(*) filter (g = 1) as n_b from s group by key having count(distinct g) = 2
), m as (
  select *, unnest(range(1 << (n_a + n_b)::int)) as mask from l
), c as (
  select key, mask, n_a, n_b, list_sum([vs[i] for i in range(1, n_a + n_b + 1) if (mask >> (i - 1)::int) & 1 = 1]) as up, list_sum(vs) as total from m where bit_count(mask) = n_a
), f as (
  select *, abs(up / n_a - (total - up) / n_b) as far, first_value(up / n_a - (total - up) / n_b) over (partition by key order by mask) as seen from c
), {_corrected("select key, '0' as group_a, '1' as group_b, any_value(n_a) as n_a, any_value(n_b) as n_b, any_value(seen) as difference, avg((far >= abs(seen) - 1e-7)::int) as p from f group by key")}
select key, group_a, group_b, n_a, n_b, round(difference, 6) as difference, round(p, 6) as p, round(p_adj, 6) as p_adj from corrected""")
def compare_groups_exact(spark, d):
    """Every relabelling of a small group counts (here all are at a hundred suppliers), so p is the same each time; larger groups take draws."""
    s = load(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), (F.col("s_suppkey") % 2).alias("g"), "s_acctbal")
    return rounded(stats.compare_groups(s, "s_acctbal", "g", ("key",)).drop("sig", "significant"))


_PICK = "exp(lgamma(n + 1::double) - lgamma(q + 1::double) - lgamma(n - q + 1::double) + q * ln(i / n::double) + (n - q) * ln(1 - i / n::double))"
#: From samples (label, x) to the law of the bootstrap median, and its interval.
INTERVAL = f"""xs as (
  select label, x, row_number() over (partition by label order by x) as i, count(*) over (partition by label) as n from samples
), cdf as (
  select *, (n + 1) // 2 as m, case when i = n then 1 else list_sum([{_PICK} for q in range((n + 1) // 2, n + 1)]) end as up from xs
), own as (
  select *, up - coalesce(lag(up) over (partition by label order by i), 0) as p from cdf
), pairs as (
  select a.label, a.i, (a.x + b.x) / 2 as v, exp(lgamma(a.n + 1::double) - 2 * lgamma(a.m + 1::double))
    * (pow(a.i / a.n::double, a.m) - pow((a.i - 1) / a.n::double, a.m)) * (pow((a.n - b.i + 1) / a.n::double, a.m) - pow((a.n - b.i) / a.n::double, a.m)) as p
  from own a join own b on a.label = b.label and a.i < b.i where a.n % 2 = 0
), law as (
  select label, x as v, p from own where n % 2 = 1 union all select label, v, p from pairs
  union all select own.label, x, greatest(0, own.p - coalesce(t.p, 0)) from own left join (select label, i, sum(p) as p from pairs group by all) t using (label, i) where n % 2 = 0
), steps as (
  select label, v, sum(sum(p)) over (partition by label order by v) as up from law group by label, v
), interval_of as (
  select label, case when any_value(n) < 3 then min(x) else any_value(low) end as ci_low, case when any_value(n) < 3 then max(x) else any_value(high) end as ci_high
  from xs join (select label, min(v) filter (up >= 0.025 - 1e-9) as low, min(v) filter (up >= 0.975 - 1e-9) as high from steps group by label) using (label) group by label
)"""


@query(f"{ANIMALS}, samples as (select label, median_ms::double as x from animals), {INTERVAL} select label::int as label, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high from interval_of")
def bootstrap_durations(spark, d):
    return rounded(stats.bootstrap_interval(bouts.per_animal(bouts.segments(frames(spark, d), FPS)), "median_ms", ("label",)))


@query(f"""{ANIMALS}, samples as (select label, median_ms::double as x from animals), {INTERVAL}
select label::int as label, count(*) as n_animals, round(median(median_ms)::double, 6) as median_ms, round(any_value(ci_low), 6) as ci_low, round(any_value(ci_high), 6) as ci_high from animals join interval_of using (label) group by label""")
def duration_intervals(spark, d):
    """The summary across animals with its interval."""
    animals = bouts.per_animal(bouts.segments(frames(spark, d), FPS))
    return rounded(bouts.with_interval(bouts.across_animals(animals), animals).select("label", "n_animals", "median_ms", "ci_low", "ci_high"))


@query(f"""{ANIMALS} select label::int as label, count(*) as n, round(avg(duration_ms)::double, 6) as mean_ms, round(median(duration_ms)::double, 6) as median_ms, round(coalesce(stddev_samp(duration_ms), 0), 6) as sd_ms,
  round(coalesce(stddev_samp(duration_ms) / sqrt(count(*)), 0), 6) as sem_ms, round(quantile_cont(duration_ms, 0.25)::double, 6) as q1_ms, round(quantile_cont(duration_ms, 0.75)::double, 6) as q3_ms from bouts group by label""")
def one_animal_durations(spark, d):
    """All bouts as the sample, as for a single animal."""
    return rounded(bouts.one_animal(bouts.segments(frames(spark, d), FPS)))


@query(f"""{ANIMALS}, vals as (select label, log10(mean_ms::double) as x from animals where mean_ms > 0),
about as (select label, count(*) as n, min(x) as low, max(x) as high, stddev_samp(x) * pow(count(*), -0.2::double) as wide from vals group by label having count(*) >= 3 and max(x) > min(x)),
bins as (select label, least(511, floor((x - low) / ((high - low) / 512)))::int as bin, count(*) as c from vals join about using (label) group by all),
laid as (select label, p as point, low + p / 199.0::double * (high - low) as x, low + (bin + 0.5::double) * ((high - low) / 512) as centre, c, n, wide from bins join about using (label), range(200) p(p)),
dens as (select label, point, any_value(x) as x, sum(c * exp(-pow((x - centre) / wide, 2) / 2) / (n * wide * 2.5066282746310002::double)) as density from laid group by label, point)
select label::int as label, point::int as point, round(pow(10, x), 5) as x, round(density, 5) as density, round(density / max(density) over (partition by label), 5) as relative from dens""")
def duration_densities(spark, d):
    """The half violins of each prototype's mean durations, on a logarithmic axis."""
    animals = bouts.per_animal(bouts.segments(frames(spark, d), FPS))
    return rounded(density.kernel_density(animals, "mean_ms", ("label",), log=True), 5)


@query(f"""with {FRAMES}, q as (select grp, label, count(*) as n, quantile_cont(x, 0.25) as q1, median(x) as median, quantile_cont(x, 0.75) as q3 from frames group by all)
select grp, label::int as label, n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(min(x) filter (x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as low,
  round(max(x) filter (x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as high, count(*) filter (x not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_outside
from frames join q using (grp, label) group by all""")
def box_statistics(spark, d):
    return rounded(density.box_statistics(frames(spark, d), "x", ("grp", "label")))
