"""SQL with the results of the queries that SQL can express."""

from __future__ import annotations

_U = "nullif(trim(user_id, E' \\t\\r\\n'), '')"
_B = "nullif(trim(business_id, E' \\t\\r\\n'), '')"

_SETS = f"""
with e as (select distinct {_B} as b, {_U} as u from yelp_train where {_B} is not null and {_U} is not null),
big as (select b, count(*) as n from e group by b having count(*) >= 5),
t as (select e.b, e.u, n from e join big using (b)),
shared as (
  select x.b as b1, y.b as b2, x.n as n1, y.n as n2, count(*) as o
  from t x join t y on x.u = y.u and x.b < y.b group by all),
pairs as (select * from shared where 2 * o >= n1 + n2 - o)"""

_BASKETS = f"""
with e as (select distinct {_U} as u, {_B} as b from small2 where {_B} is not null and {_U} is not null),
total as (select count(distinct u) as n from e),
singles as (select b, count(*) as n1 from e group by b),
both_ as (
  select x.b as b1, y.b as b2, count(*) as n12 from e x join e y on x.u = y.u and x.b < y.b group by all having count(*) >= 5),
scored as (
  select b1, b2, p.n1 as n1, q.n1 as n2, n12, n from both_ join singles p on p.b = b1 join singles q on q.b = b2, total
  where n12 * 1000 >= 5 * n and 2 * n12 * n >= 5 * p.n1 * q.n1)"""

_FREQUENT = f"""
with k as (
  select 'business_id' as field, {_B} as key_value from review union all select 'user_id', {_U} from review),
c as (
  select field, key_value, count(*) as n, cast(sum(count(*)) over (partition by field) as bigint) as total
  from k where key_value is not null group by field, key_value),
f as (select * from c where n * 100 >= total)"""

SQL = {
    "p2_found": f"{_SETS} select b1 as business_id_1, b2 as business_id_2 from pairs",
    "p2_classes": f"""{_SETS},
whole as (select b, n, list(u order by u) as s from t group by b, n),
classes as (select b, n, min(b) over (partition by s) as c from whole),
ends as (
  select b1 as c from pairs where n1 + n2 > 2 * o and b1 in (select c from classes) and b2 in (select c from classes)
  union all
  select b2 from pairs where n1 + n2 > 2 * o and b1 in (select c from classes) and b2 in (select c from classes))
select b as business_id, c as class_id, n as users, (select count(*) from ends where ends.c = classes.c) as links
from classes""",
    "p3_found": f"{_BASKETS} select b1 as business_id_1, b2 as business_id_2 from scored",
    "p3_scores": f"""{_BASKETS} select b1 as business_id_1, b2 as business_id_2, n1, n2, n12, n as baskets,
round(n12::double * n / (n1::double * n2), 6) as lift,
case when n12 < n1 then round((1 - n2::double / n) / (1 - n12::double / n1), 6) end as conviction from scored""",
    "p5_found": f"{_FREQUENT} select field, key_value from f",
    "p5_counts": f"{_FREQUENT} select field, key_value, n, total, true as within_bounds from f",
}
