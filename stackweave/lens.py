"""The domain tables of the engine, read off the star-schema test tables.  The same SQL serves Spark and the DuckDB oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

LENS: dict[str, str] = {
    "repos": """
select c_custkey as repo_id, concat('org', cast(c_nationkey as string), '/', replace(lower(c_name), '#', '-')) as full_name,
       cast(floor(greatest(c_acctbal, 0)) as bigint) as stars, case when n_nationkey % 7 = 3 then null else n_name end as primary_language,
       case when n_regionkey < 2 then 'Organization' when n_regionkey < 4 then 'User' end as owner_type, c_nationkey as org_id, c_mktsegment as segment,
       c_custkey % 17 = 0 as is_archived, c_custkey % 19 = 0 as is_fork, c_custkey % 101 = 0 as is_template
from customer join nation on c_nationkey = n_nationkey""",
    "order_stats": """
select o_custkey as repo_id, count(*) as n_orders, sum(case when o_orderstatus = 'F' then 1 else 0 end) as n_f,
       sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as n_urgent,
       max(case when o_orderstatus = 'P' then 1 else 0 end) as has_p
from orders group by o_custkey""",
    "decisions": """
select repo_id, full_name, stars, segment as primary_segment, cast(n_f as int) as score_serious, cast(n_urgent as int) as score_ai,
       stars >= 1000 as passed_candidate, n_f >= 3 as passed_serious, n_f >= 3 and n_urgent >= 3 as passed_ai,
       n_f >= 3 and n_urgent >= 3 and stars >= 1000 as passed_major, n_f >= 2 and n_urgent >= 3 and stars >= 1000 as rule_passed_major,
       case when repo_id % 11 = 0 then 'hard exclusion' end as exclusion_reason
from repos join order_stats using (repo_id)""",
    "technologies": """
select s_suppkey as technology_id, replace(lower(s_name), '#', '-') as display_name, r_name as category_id,
       case when s_nationkey % 5 = 0 then null else s_nationkey end as provider_id, s_suppkey % 10 as family_no
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "evidence": """
select o_custkey as repo_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
       case when p_size % 5 = 0 then concat('@', replace(lower(p_brand), '#', ''), '/', replace(p_name, ' ', '-'))
            when p_size % 5 = 1 then replace(p_name, ' ', '_') when p_size % 5 = 2 then replace(p_name, ' ', '.') else replace(p_name, ' ', '-') end as package_name,
       case when l_returnflag <> 'N' then l_suppkey end as technology_id,
       case when l_returnflag = 'A' and l_linestatus = 'F' then 'manifest' when l_returnflag = 'A' then 'sbom' when l_returnflag = 'R' and l_linestatus = 'F' then 'import'
            when l_returnflag = 'R' then 'repo_identity' when l_linestatus = 'F' then 'manifest' else 'readme_mention' end as evidence_type,
       case l_linenumber % 5 when 0 then 'runtime' when 1 then 'optional' when 2 then 'prod' when 3 then 'unknown' else 'dev' end as scope,
       case when l_discount < 0.03 then 'high' when l_discount < 0.07 then 'medium' else 'low' end as confidence,
       case l_linenumber % 4 when 0 then 'package.json' when 1 then 'src/app/requirements.txt' when 2 then 'docs/pyproject.toml' else 'x/go.mod' end as source_path
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "edges": """
select repo_id, technology_id, max(case evidence_type when 'repo_identity' then 4 when 'manifest' then 3 when 'sbom' then 2 else 1 end) as strength,
       min(evidence_type) as evidence_type, count(*) as n_evidence
from evidence join decisions using (repo_id)
where technology_id is not null and passed_major and l_shipdate >= timestamp '1998-01-01 00:00:00' and l_shipdate < timestamp '1998-07-01 00:00:00'
group by repo_id, technology_id""",
    "old_edges": """
select distinct repo_id, technology_id from evidence join decisions using (repo_id)
where technology_id is not null and passed_major and l_shipdate >= timestamp '1998-03-01 00:00:00' and l_shipdate < timestamp '1998-09-01 00:00:00'""",
    "old_decisions": """
select repo_id, full_name, stars, case when repo_id % 13 = 0 then 'BUILDING' else primary_segment end as primary_segment,
       score_serious >= 4 and score_ai >= 3 and stars >= 1000 as passed_major from decisions where repo_id % 29 <> 0""",
    "judge": """
select doc_id as repo_id, case when doc_id % 3 = 0 then 'validation' else 'hardening' end as judge_mode, quality = 1 as include_in_final_set,
       case doc_id % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as confidence, toxic = 0 as ai_relevant from labels""",
}


def needs(name: str) -> list[str]:
    """Base tables and domain tables that a domain table or query text names, in order of definition."""
    out: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_]+\b", sql)):
            if word in LENS and word not in out:
                visit(LENS[word])
                out.append(word)

    visit(LENS.get(name, name))
    return out + [name] if name in LENS else out


def oracle(sql: str) -> str:
    """A DuckDB query with the domain tables that it names as CTEs."""
    used = [n for n in LENS if n in set(needs(sql))]
    head = ", ".join(f"{n} as ({LENS[n].strip()})" for n in used)
    text = sql.strip()
    if not head:
        return text
    if text.startswith("with recursive "):
        return f"with recursive {head}, {text[15:]}"
    return f"with {head}, {text[5:]}" if text.startswith("with ") else f"with {head} {text}"


class Lens:
    """Domain and base tables of a folder as DataFrames: lens.repos, lens.lineitem."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__["made"]
        if name not in made:
            if name in BASE:
                made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            elif name in LENS:
                named = {w: getattr(self, w) for w in dict.fromkeys(re.findall(r"\b[a-z_]+\b", LENS[name])) if w in BASE or (w in LENS and w != name)}
                named = {w: df for w, df in named.items() if re.search(rf"(from|join)\s+{w}\b", LENS[name])}
                made[name] = self.spark.sql(re.sub(r"\b(from|join)\s+([a-z_]+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in named else m[0], LENS[name]), **named)
            else:
                raise AttributeError(name)
        return made[name]
