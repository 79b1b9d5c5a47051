"""Queries over scopes, timelines and operational tables, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.operators import scope, timeline, usage
from codicil.plans.views import Views, with_views
from codicil.sources import tables

D = "date '1998-06-01'"
QUERIES, SQL = {}, {}


def day() -> Column:
    """The day that queries ask about."""
    return F.lit("1998-06-01").cast("date")


def query(name: str, sql: str | None):
    def add(build):
        QUERIES[name] = lambda spark, directory: build(Views(spark, directory))
        if sql:
            SQL[name] = with_views(sql)
        return build

    return add


REACH = "r.organization_id = p.organization_id and (p.role = 'admin' or r.branch_id is null or r.branch_id = p.branch_id)"


@query("visible", f"""
, seen as (
  select p.user_id, r.policy_id from principals p join policies r on {REACH} where p.role in ('admin', 'manager')
  union all select p.user_id, r.policy_id from principals p join assignments a using (user_id) join policies r on r.policy_id = a.policy_id and {REACH} where p.role = 'user')
select user_id, count(*) as n_visible, min(policy_id) as first_policy, max(policy_id) as last_policy from seen group by user_id""")
def visible(v: Views) -> DataFrame:
    return scope.visible_counts(v.policies(), v.principals(), v.assignments())


@query("write_scope", f"""
select p.user_id, count(*) as reached, count(*) filter (p.role = 'admin' or (p.role = 'manager' and r.branch_id = p.branch_id)) as writable
from principals p join policies r on {REACH} group by p.user_id""")
def write_scope(v: Views) -> DataFrame:
    return scope.write_counts(v.policies(), v.principals())


@query("assignable", f"""
select r.policy_id, p.user_id, p.name, a.user_id is not null as assigned from policies r join principals p on {REACH} and p.role = 'user'
left join assignments a on a.user_id = p.user_id and a.policy_id = r.policy_id
qualify row_number() over (partition by r.policy_id order by p.name, p.user_id) <= 200""")
def assignable(v: Views) -> DataFrame:
    return scope.assignable(v.policies(), v.principals(), v.assignments())


@query("audience", f"""
select a.policy_id, a.user_id from assignments a join principals p using (user_id) join policies r using (policy_id) where p.role = 'user'
union select r.policy_id, p.user_id from policies r join principals p on {REACH} where p.role = 'manager'""")
def audience(v: Views) -> DataFrame:
    return scope.audience(v.policies(), v.principals(), v.assignments())


@query("timeline", "select * from timeline")
def build(v: Views) -> DataFrame:
    return timeline.build_timeline(v.versions())


@query("timeline_states", f"""
select policy_id, version_id, case when status = 'withdrawn' then 'withdrawn' when effective_from > {D} then 'scheduled' when effective_to <= {D} then 'historical' else 'current' end as state
from timeline""")
def states(v: Views) -> DataFrame:
    return timeline.with_state(timeline.build_timeline(v.versions()), day()).select("policy_id", "version_id", "state")


@query("in_force", f"select policy_id, version_id, effective_from from timeline where effective_from <= {D} and (effective_to is null or effective_to > {D})")
def in_force(v: Views) -> DataFrame:
    return timeline.build_timeline(v.versions()).filter(timeline.effective_on(day())).select("policy_id", "version_id", "effective_from")


@query("asof_join", """
select l_orderkey, l_linenumber, o_custkey as policy_id, cast(l_shipdate as date) as day, t.version_id, t.effective_from
from lineitem join orders on o_orderkey = l_orderkey
left join timeline t on t.policy_id = o_custkey and t.effective_from <= cast(l_shipdate as date) and (t.effective_to is null or t.effective_to > cast(l_shipdate as date))""")
def asof(v: Views) -> DataFrame:
    lines = v.table("lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    facts = lines.join(v.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("policy_id")), "l_orderkey")
    return timeline.asof_join(facts, timeline.build_timeline(v.versions()), "policy_id", "day")


@query("previous_version", "select policy_id, version_id, lag(version_id) over w as previous_id, lag(effective_from) over w as previous_from from versions window w as (partition by policy_id order by effective_from, version_id)")
def previous(v: Views) -> DataFrame:
    return timeline.previous_version(v.versions())


@query("without_successor", "select policy_id, version_id, effective_from from versions a where not exists (select 1 from versions b where b.policy_id = a.policy_id and b.effective_from > a.effective_from)")
def successor(v: Views) -> DataFrame:
    return timeline.without_successor(v.versions()).select("policy_id", "version_id", "effective_from")


@query("timeline_conflicts", """
select policy_id, version_id, registered_on, min(version_id) over (partition by policy_id, registered_on) as first_id from registrations
where date_source in ('entered', 'detected') qualify count(*) over (partition by policy_id, registered_on) > 1""")
def conflicts(v: Views) -> DataFrame:
    return timeline.timeline_conflicts(v.registrations())


@query("withdraw", """
select policy_id, version_id, effective_from, lead(effective_from) over w as effective_to, lag(version_id) over w as supersedes
from versions where status = 'active' and version_id % 3 <> 0 window w as (partition by policy_id order by effective_from, version_id)""")
def withdraw(v: Views) -> DataFrame:
    status = F.when(F.col("version_id") % 3 == 0, "withdrawn").otherwise(F.col("status"))
    return timeline.build_timeline(v.versions().withColumn("status", status)).select("policy_id", "version_id", "effective_from", "effective_to", "supersedes")


@query("make_room", """
, wanted as (select policy_id, max(effective_from) as day from versions group by policy_id),
runs as (select policy_id, version_id, date_source, day, effective_from + cast(row_number() over (partition by policy_id order by effective_from desc) as int) as island from versions join wanted using (policy_id) where effective_from <= day),
hit as (select policy_id, version_id, min(date_source in ('upload_date', 'inferred')) over (partition by policy_id) as moves from runs where island = day + 1)
select v.policy_id, v.version_id, case when moves then effective_from - 1 else effective_from end as effective_from, coalesce(moves, false) as moved, coalesce(not moves, false) as conflict
from versions v left join hit using (policy_id, version_id)""")
def room(v: Views) -> DataFrame:
    wanted = v.versions().groupBy("policy_id").agg(F.max("effective_from").alias("day"))
    return timeline.make_room(v.versions(), wanted)


@query("number_versions", """
select policy_id, version_id, version_label, cast(row_number() over (partition by policy_id order by version_id) as int) as number,
  cast(row_number() over (partition by policy_id, version_label order by version_id) as int) as revision from versions""")
def numbers(v: Views) -> DataFrame:
    return timeline.number_versions(v.versions())


@query("expiry", f"""
, ends as (select *, effective_from + 365 as ends_on, row_number() over (partition by policy_id order by effective_from desc) as k from versions where status = 'active')
select policy_id, version_id, ends_on as effective_to, case when ends_on <= {D} then 'expired' else 'expiring' end as kind from ends where k = 1 and ends_on <= {D} + 30""")
def expiry(v: Views) -> DataFrame:
    return timeline.expiry(v.versions().withColumn("effective_to", F.date_add("effective_from", 365)), day(), 30)


@query("newer_versions", f"""
, names as (select policy_id, organization_id || '|' || lower(trim(category)) || (policy_id % 50) as same from policies),
items as (select policy_id, version_id, effective_from from timeline where effective_from <= {D} and (effective_to is null or effective_to > {D}))
select i.policy_id, i.version_id, i.effective_from, v.version_id as newer_id, v.effective_from as newer_from
from items i join names a using (policy_id) join names b on a.same = b.same join versions v on v.policy_id = b.policy_id and v.status = 'active' and v.effective_from > i.effective_from""")
def newer(v: Views) -> DataFrame:
    items = timeline.build_timeline(v.versions()).filter(timeline.effective_on(day())).select("policy_id", "version_id", "effective_from")
    named = v.policies().withColumn("name", F.concat("category", (F.col("policy_id") % 50).cast("string")))
    return timeline.newer_versions(items, v.versions(), named)


@query("version_sets", f"""
select policy_id, version_id, cast(row_number() over (partition by policy_id order by effective_from desc) as int) as depth from timeline t where effective_to <= {D}
and exists (select 1 from timeline s where s.policy_id = t.policy_id and s.effective_from <= {D} and (s.effective_to is null or s.effective_to > {D}))""")
def sets(v: Views) -> DataFrame:
    return timeline.version_sets(timeline.build_timeline(v.versions()), day())


@query("real_dates", "select policy_id, version_id, case when date_source in ('entered', 'detected') then effective_from end as stated_from from versions")
def real_dates(v: Views) -> DataFrame:
    return v.versions().select("policy_id", "version_id", timeline.real_date().alias("stated_from"))


@query("having_version", f"select policy_id, name from policies p where exists (select 1 from timeline t where t.policy_id = p.policy_id and t.effective_from > {D})")
def having(v: Views) -> DataFrame:
    late = timeline.build_timeline(v.versions()).filter(F.col("effective_from") > day())
    return v.policies().join(late, "policy_id", "left_semi").select("policy_id", "name")


@query("version_counts", "select policy_id, count(*) as n_versions from versions where status = 'active' group by policy_id")
def version_counts(v: Views) -> DataFrame:
    return usage.version_counts(v.versions())


@query("category_summary", """
select category, count(distinct p.policy_id) as n_policies, count(version_id) as n_versions, max(effective_from) as latest from policies p left join versions v using (policy_id) group by category""")
def categories(v: Views) -> DataFrame:
    return usage.category_summary(v.policies(), v.versions())


@query("versions_with_files", f"""
select p.policy_id, p.name, v.version_id, v.version_label, v.effective_from, t.effective_to is null as is_latest from policies p join versions v using (policy_id)
join timeline t using (version_id)""")
def files(v: Views) -> DataFrame:
    t = timeline.build_timeline(v.versions()).select("version_id", F.col("effective_to").isNull().alias("is_latest"))
    mine = v.policies().select("policy_id", "name")
    return mine.join(v.versions(), "policy_id").join(t, "version_id").select("policy_id", "name", "version_id", "version_label", "effective_from", "is_latest")


@query("dashboard_counts", "select status, date_source, count(*) as n, count(*) filter (policy_id % 2 = 0) as n_even from registrations group by all")
def dashboard(v: Views) -> DataFrame:
    return v.registrations().groupBy("status", "date_source").agg(F.count("*").alias("n"), F.count_if(F.col("policy_id") % 2 == 0).alias("n_even"))


@query("message_counts", "select conv_id, count(*) as n_messages, count(*) filter (role = 'user') as n_user, max(turn) as last_turn from conversations group by conv_id")
def messages(v: Views) -> DataFrame:
    return usage.message_counts(v.table("conversations"))


@query("usage_daily", """
select cast(created_at as date) as day, service, model, count(*) as calls, sum(input_tokens) as input_tokens, sum(output_tokens) as output_tokens
from usage where not failed group by all""")
def daily(v: Views) -> DataFrame:
    return usage.usage_daily(v.usage())


PRICES = [("model", 1.0, 2.0), ("model-1", 2.0, 4.0), ("model-2", 0.5, 1.0)]


@query("usage_cost", """
, prices(prefix, input_price, output_price) as (values ('model', 1.0::double, 2.0::double), ('model-1', 2.0::double, 4.0::double), ('model-2', 0.5::double, 1.0::double)),
per_model as (select model, sum(input_tokens) as i, sum(output_tokens) as o from usage where not failed group by model),
best as (select m.*, input_price, output_price, row_number() over (partition by model order by length(prefix) desc) as k from per_model m left join prices on starts_with(model, prefix))
select model, i as input_tokens, o as output_tokens, (i * input_price + o * output_price) / 1000000 as cost from best where k = 1""")
def cost(v: Views) -> DataFrame:
    prices = v.spark.createDataFrame(PRICES, "prefix string, input_price double, output_price double")
    return usage.usage_cost(v.usage(), prices)


@query("usage_totals", """
select service, coalesce(sum(input_tokens) filter (cast(created_at as date) = date '2024-01-20'), 0) as today,
  coalesce(sum(input_tokens) filter (cast(created_at as date) >= date '2024-01-15'), 0) as since, sum(input_tokens) as total from usage where not failed group by service""")
def totals(v: Views) -> DataFrame:
    return usage.usage_totals(v.usage(), "2024-01-20", "2024-01-15")


@query("usage_series", """
, days as (select cast(d as date) as day from range(date '2024-01-10', date '2024-01-24', interval 1 day) t(d))
select day, coalesce(calls, 0) as calls, coalesce(tokens, 0) as tokens from days left join (
  select cast(created_at as date) as day, count(*) as calls, sum(input_tokens + output_tokens) as tokens from usage where not failed group by 1) using (day)""")
def series(v: Views) -> DataFrame:
    return usage.usage_series(v.usage(), "2024-01-23", 14)


@query("out_of_credit", """
select user_id, max(created_at) filter (failed) as last_refusal, max(created_at) filter (not failed) as last_success,
  coalesce(max(created_at) filter (failed) > max(created_at) filter (not failed), max(created_at) filter (failed) is not null) as out_of_credit from usage group by user_id""")
def credit(v: Views) -> DataFrame:
    return usage.out_of_credit(v.usage(), "user_id")


@query("audit_list", "select event_id, user_id, service, created_at from usage where service = 'purchase' and created_at >= timestamp '2024-01-12'")
def audit(v: Views) -> DataFrame:
    return usage.audit_list(v.usage(), service="purchase", since="2024-01-12").select("event_id", "user_id", "service", "created_at")


@query("recent_queries", "select user_id, event_id, created_at from usage qualify row_number() over (partition by user_id order by created_at desc, event_id desc) <= 8")
def recent(v: Views) -> DataFrame:
    return usage.newest(v.usage(), "user_id", "created_at", "event_id", 8).select("user_id", "event_id", "created_at")


@query("arranged_order", """
select policy_id, category, cast(row_number() over (partition by category order by case when policy_id % 3 = 0 then policy_id end nulls first, effective_from desc, policy_id) as int) as place
from policies join (select policy_id, max(effective_from) as effective_from from versions group by 1) using (policy_id)""")
def arranged(v: Views) -> DataFrame:
    latest = v.versions().groupBy("policy_id").agg(F.max("effective_from").alias("effective_from"))
    shown = F.when(F.col("policy_id") % 3 == 0, F.col("policy_id"))
    place = F.row_number().over(Window.partitionBy("category").orderBy(shown.asc_nulls_first(), F.desc("effective_from"), "policy_id")).cast("int")
    return v.policies().join(latest, "policy_id").select("policy_id", "category", place.alias("place"))


@query("append_new", "select o_orderkey, o_custkey from orders o where not exists (select 1 from orders t where t.o_orderpriority = '1-URGENT' and t.o_orderkey = o.o_orderkey)")
def append(v: Views) -> DataFrame:
    rows = v.table("orders")
    return tables.append_new(rows.select("o_orderkey", "o_custkey"), rows.filter("o_orderpriority = '1-URGENT'"), ["o_orderkey"])


@query("upsert", "select o_orderkey, case when o_orderstatus = 'O' then 'changed' else o_orderpriority end as o_orderpriority from orders")
def upsert(v: Views) -> DataFrame:
    rows = v.table("orders").select("o_orderkey", "o_orderpriority")
    fresh = v.table("orders").filter("o_orderstatus = 'O'").select("o_orderkey").withColumn("o_orderpriority", F.lit("changed"))
    return tables.upsert(fresh, rows, ["o_orderkey"], "o_orderpriority")


@query("sync_scope", "select o_orderkey, c_nationkey as scope from orders join customer on c_custkey = o_custkey")
def sync(v: Views) -> DataFrame:
    rows = v.table("orders").select("o_orderkey", "o_custkey", F.lit(-1).alias("scope"))
    owners = v.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("scope"))
    return tables.sync_scope(rows, owners, "o_custkey", ["scope"]).select("o_orderkey", "scope")
