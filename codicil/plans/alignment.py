"""SQL of the alignment of two versions' sections: all passes over a table `whole`."""

from __future__ import annotations

from codicil.plans.catalog_text import KEYED

KEY_OF = KEYED.replace("lower(t)", "lower(coalesce(title, ''))")
EXACT = [("number", "number"), ("front", "case when level = 0 then 'front' end"), ("title", "key")]

def aligned_sql(whole: str) -> str:
    """SQL of all passes over the table `whole` that the text given ends with: exact keys by occurrence, then greedy folds over scored pairs."""
    out = [f"""{whole},
pairs as (select lag(version_id) over (partition by policy_id order by effective_from, version_id) as old_id, version_id as new_id from versions where status = 'active' qualify old_id is not null),
l0 as (select old_id, new_id, place, number, level, {KEY_OF} as key, coalesce(content, '') as content from pairs join whole on version_id = old_id),
r0 as (select old_id, new_id, place, number, level, {KEY_OF} as key, coalesce(content, '') as content from pairs join whole on version_id = new_id)"""]  # fmt: skip
    rest = lambda side, i, place: f"{side}{i + 1} as (select x.* from {side}{i} x anti join m{i} on x.old_id = m{i}.old_id and x.new_id = m{i}.new_id and x.place = m{i}.{place})"
    for i, (by, key) in enumerate(EXACT):
        ranked = lambda side: f"(select *, {key} as k, row_number() over (partition by old_id, new_id, {key} order by place) as c from {side}{i} where {key} is not null)"  # noqa: B023, E731
        out.append(f"m{i} as (select a.old_id, a.new_id, a.place as old_place, b.place as new_place, '{by}' as by from {ranked('l')} a join {ranked('r')} b on a.old_id = b.old_id and a.new_id = b.new_id and a.k = b.k and a.c = b.c)")
        out += [rest("l", i, "old_place"), rest("r", i, "new_place")]
    fold = "unnest(list_reduce(list([{'o': o, 'n': n}] order by o, n), lambda acc, x: case when len(list_filter(acc, lambda y: y.o = x[1].o or y.n = x[1].n)) > 0 then acc else list_concat(acc, x) end)) as g"
    taken = lambda i, source, by: f"m{i} as (select old_id, new_id, g.o as old_place, g.n as new_place, '{by}' as by from (select old_id, new_id, {fold} from {source} group by old_id, new_id))"
    out.append("""
holds as (
  select l.old_id, l.new_id, l.place as o, r.place as n, l.content as x, r.content as y from l3 l join r3 r using (old_id, new_id) where l.key <> '' and r.key <> '' and (contains(l.key, r.key) or contains(r.key, l.key))),
letters as (select old_id, new_id, o, n, x, y, ch, count(*) filter (s = 0) as p, count(*) filter (s = 1) as q from (
  select *, 0 as s, unnest(string_split(x, '')) as ch from holds union all select *, 1, unnest(string_split(y, '')) from holds) where ch <> '' group by all),
nested as (select old_id, new_id, o, n from letters group by all having 2 * sum(least(p, q)) >= 0.6 * (length(x) + length(y)) union select old_id, new_id, o, n from holds where x = '' and y = '')""".replace("group by all having", "group by old_id, new_id, o, n, x, y having"))  # fmt: skip
    out += [taken(3, "nested", "nested title"), rest("l", 3, "old_place"), rest("r", 3, "new_place")]
    best = "list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: {'k': len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda k: a[i + 1:i + k] = b[j + 1:j + k])), 'i': -i, 'j': -j}))))"
    out.append(f"""
near_titles as (
  select distinct l.key as a, r.key as b from l4 l join r4 r using (old_id, new_id) where 2 * least(length(l.key), length(r.key)) >= 0.75 * (length(l.key) + length(r.key))),
blocks as (
  with recursive b(a, b, alo, ahi, blo, bhi, best) as (
    select a, b, alo, ahi, blo, bhi, {best} from (select a, b, 0 as alo, length(a) as ahi, 0 as blo, length(b) as bhi from near_titles)
    union all
    select a, b, alo, ahi, blo, bhi, {best} from (
      select a, b, unnest([alo, best.k - best.i]) as alo, unnest([-best.i, ahi]) as ahi, unnest([blo, best.k - best.j]) as blo, unnest([-best.j, bhi]) as bhi from b where best.k > 0)
    where alo < ahi and blo < bhi)
  select a, b, sum(coalesce(best.k, 0)) as shared from b group by a, b),
alike as (
  select l.old_id, l.new_id, l.place as o, r.place as n from l4 l join r4 r using (old_id, new_id) join blocks on a = l.key and b = r.key where 2 * shared >= 0.75 * (length(a) + length(b)))""")  # fmt: skip
    out += [taken(4, "alike", "alike title"), rest("l", 4, "old_place"), rest("r", 4, "new_place")]
    out.append(
        "aligned as (" + " union all ".join(f"select * from m{i}" for i in range(5))
        + " union all select old_id, new_id, place, null, 'removed' from l5 union all select old_id, new_id, null, place, 'added' from r5)"
    )
    return ",\n".join(out)
