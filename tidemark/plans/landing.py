"""Queries over sources and sinks: every source reads what was landed before, so SQL over the tables tells what must come back."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import lake, registry
from tidemark.plans import views
from tidemark.plans.registry import Registry, plain, rows_n
from tidemark.session import scratch, table
from tidemark.sources import readers

entry = Registry()
QUERIES, ORACLE = entry.queries, entry.oracle


def _told(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "step string, result string")


@entry("S01_bound_query", "select o_orderkey, o_totalprice from orders where o_orderpriority = '1-URGENT' and o_totalprice >= 250000 and o_orderdate >= timestamp '1999-01-01'")
def s01_bound_query(spark, sf):
    sql = "select o_orderkey, o_totalprice from {o} where o_orderpriority = :p and o_totalprice >= :least and o_orderdate >= cast(:since as timestamp_ntz)"
    return readers.bound_query(spark, sql, {"p": "1-URGENT", "least": 250000, "since": "1999-01-01"}, o=table(spark, sf, "orders"))


@entry("S02_chunked_scan", "select l_returnflag, count(*) n, sum(l_quantity) quantity from lineitem group by 1")
def s02_chunked_scan(spark, sf):
    """Work in parts: aggregates of each part, added up."""
    parts = [c.groupBy("l_returnflag").agg(rows_n(), F.sum("l_quantity").alias("quantity")) for c in readers.hashed_chunks(table(spark, sf, "lineitem"), "l_orderkey", 4)]
    return reduce(DataFrame.unionByName, parts).groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))


@entry("S03_attached_databases", "select c_mktsegment, count(*) n, round(sum(o_totalprice), 2) total from orders join customer on o_custkey = c_custkey group by 1")
def s03_attached_databases(spark, sf):
    readers.attach(spark, "ledger", sf)
    readers.attach(spark, "people", sf)
    return spark.sql("select c_mktsegment, count(*) n, round(sum(o_totalprice), 2) total from ledger_orders join people_customer on o_custkey = c_custkey group by 1")


@entry("S04_read_only", "select * from (values ('read', 'allowed'), ('write', 'refused')) t(step, result)")
def s04_read_only(spark, sf):
    """An attached table can be read and not be written."""
    folder = scratch(spark, "archive")
    table(spark, sf, "nation").write.parquet(f"{folder}/nation.parquet")
    readers.attach(spark, "archive", folder)
    out = [("read", "allowed" if spark.table("archive_nation").count() else "empty")]
    try:
        spark.sql("insert into archive_nation select * from archive_nation")
        out.append(("write", "allowed"))
    except AnalysisException:
        out.append(("write", "refused"))
    return _told(spark, out)


@entry("S05_union_by_name", "select case when o_orderdate < timestamp '1998-01-01' then 'old' else 'new' end as part, count(*) n, count(*) filter (o_orderdate >= timestamp '1998-01-01') n_priority, count(*) filter (o_orderdate < timestamp '1998-01-01') n_status from orders group by 1")
def s05_union_by_name(spark, sf):
    """Files of different columns, matched by name, with the file of every row."""
    o, base = table(spark, sf, "orders"), scratch(spark, "by-name")
    o.where("o_orderdate < timestamp_ntz '1998-01-01'").select("o_orderkey", "o_orderstatus").write.parquet(f"{base}/old")
    o.where("o_orderdate >= timestamp_ntz '1998-01-01'").select("o_orderpriority", "o_orderkey").write.parquet(f"{base}/new")
    df = readers.parquet_files(spark, f"{base}/old", f"{base}/new")
    return df.groupBy(F.regexp_extract("source_file", "/(old|new)/", 1).alias("part")).agg(rows_n(), F.count("o_orderpriority").alias("n_priority"), F.count("o_orderstatus").alias("n_status"))


@entry("S06_partitioned_scan", "select o_orderkey from orders where year(o_orderdate) between 1996 and 1997 and o_orderstatus = 'P'")
def s06_partitioned_scan(spark, sf):
    """Folders named by their values: the year is pruned, the status pushed down."""
    path = scratch(spark, "by-year")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year")).repartition("year").write.partitionBy("year").parquet(path)
    return spark.read.parquet(path).where("year between 1996 and 1997 and o_orderstatus = 'P'").select("o_orderkey")


@entry("S07_missing_columns", "select unnest(['o_colour', 'o_weight']) as lacking where not exists (select 1 from (describe orders) where column_name in ('o_colour', 'o_weight'))")
def s07_missing_columns(spark, sf):
    lacking = readers.missing_columns(table(spark, sf, "orders"), ["o_orderkey", "o_colour", "o_totalprice", "o_weight"])
    return spark.createDataFrame([(c,) for c in lacking], "lacking string")


@entry("S08_csv_window", """select strftime(o_orderdate, '%Y-%m-%d') as day, case when o_orderkey % 7 = 0 then null else round(o_totalprice, 2) end as price, o_orderkey::varchar as id, case when o_orderkey % 7 = 0 then 'price' end as problem
    from orders where o_orderdate >= timestamp '1997-03-01' and o_orderdate < timestamp '1997-04-01'""")
def s08_csv_window(spark, sf):
    """A CSV whose header bears another name; numbers are only read inside the window, and unreadable ones told."""
    path, o = scratch(spark, "csv"), table(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 7 == 0, "n.a.").otherwise(F.round("o_totalprice", 2).cast("string"))
    o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("DATE"), price.alias("Close"), F.col("o_orderkey").alias("id")).write.option("header", "true").csv(path)
    out = readers.csv_window(spark, path, "DATE", "1997-03-01", "1997-04-01", ["price"], {"price": ["Close", "close"]})
    return out.select(F.col("DATE").cast("string").alias("day"), "price", "id", "problem")


@entry("S09_csv_calendar", "select registrant_ticker symbol, strftime(max(evidence_available_at), '%Y-%m-%d') report_day, count(*) n from evidence_claims where registrant_ticker is not null and evidence_available_at is not null group by 1")
def s09_csv_calendar(spark, sf):
    """A calendar of reports as CSV with empty fields, read with its types."""
    path = scratch(spark, "calendar")
    table(spark, sf, "evidence_claims").select(F.col("registrant_ticker").alias("symbol"), F.to_date("evidence_available_at").alias("reportDate"), F.lit(None).cast("double").alias("estimate")).write.option("header", "true").csv(path)
    df = spark.read.option("header", "true").schema("symbol string, reportDate date, estimate double").csv(path)
    return plain(df.where("symbol is not null and reportDate is not null").groupBy("symbol").agg(F.max("reportDate").alias("report_day"), rows_n()))


@entry("S10_json_lines", """select case when c_custkey % 9 <> 0 then c_custkey end id, case when c_custkey % 9 <> 0 then c_mktsegment end segment, case when c_custkey % 9 = 0 then '[' || c_custkey || ']' end corrupt from customer""")
def s10_json_lines(spark, sf):
    path = scratch(spark, "jsonl")
    c = table(spark, sf, "customer")
    good = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")))
    c.select(F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("["), F.col("c_custkey").cast("string"), F.lit("]"))).otherwise(good).alias("value")).write.text(path)
    return readers.json_lines(spark, path, T.StructType([T.StructField("id", T.LongType()), T.StructField("segment", T.StringType())]))


@entry("S11_columnar_json", "select n_nationkey::bigint id, n_name as name, case when n_nationkey < 20 then n_regionkey::bigint end region from nation")
def s11_columnar_json(spark, sf):
    """Parallel arrays of one document as rows; an array that is too short is filled up with nulls."""
    path, n = scratch(spark, "columnar"), table(spark, sf, "nation")
    ordered = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")))
    doc = n.agg(ordered.alias("r")).select(F.struct(F.col("r.n_nationkey").alias("id"), F.col("r.n_name").alias("name"), F.slice("r.n_regionkey", 1, 20).alias("region")).alias("filings"))
    doc.select(F.to_json(F.struct("filings"))).write.text(path)
    return readers.columnar_json(spark, path, {"id": "bigint", "name": "string", "region": "bigint"}, "filings")


@entry("S12_nested_lists", "select user_id, event_id id, value from events where event_id % 2 = 0 union all select user_id, event_id, value from events where event_id % 3 = 0")
def s12_nested_lists(spark, sf):
    """Lists under different paths of a payload, all of them as rows."""
    one = F.array(F.struct(F.col("event_id").alias("id"), "value"))
    ev = views.events(spark, sf).where("event_id % 2 = 0 or event_id % 3 = 0")
    inner = F.struct(F.when(F.col("event_id") % 3 == 0, one).alias("items"))
    payload = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, one).alias("feed"), inner.alias("data")))
    return readers.nested_lists(ev.select("user_id", payload.alias("payload")), "payload", ("$.feed", "$.data.items", "$.absent"), "id bigint, value double")


@entry("S13_raw_documents", "select n_regionkey::bigint region, sum(length(n_name) + 1)::bigint n_chars, true as read from nation group by 1")
def s13_raw_documents(spark, sf):
    """Packed files of raw bytes, with length, hash and text."""
    path = scratch(spark, "raw")
    table(spark, sf, "nation").orderBy("n_nationkey").coalesce(1).select("n_regionkey", "n_name").write.partitionBy("n_regionkey").option("compression", "gzip").text(path)
    df = readers.raw_documents(spark, f"{path}/*/*.gz")
    ok = F.col("read") & (F.length("sha256") == 64) & (F.col("length") > 0)
    return df.groupBy(F.regexp_extract("path", "n_regionkey=(\\d+)", 1).cast("long").alias("region")).agg(F.sum(F.length("text")).cast("long").alias("n_chars"), F.bool_and(ok).alias("read"))


@entry("S17_filing_index", """select accession_number, row_number() over (partition by accession_number order by cid) as "row", 'claim ' || cid as description, cid || '.htm' as document, '/a/' || cid as href
    from (select distinct accession_number, evidence_claim_id cid from evidence_claims where accession_number is not null)""")
def s17_filing_index(spark, sf):
    """The tables of filing-index pages as an inventory of documents."""
    c = table(spark, sf, "evidence_claims").where("accession_number is not null").select("accession_number", F.col("evidence_claim_id").alias("id")).distinct()
    tr = F.transform(F.array_sort(F.collect_list("id")), lambda x: F.concat(F.lit("<tr><td>claim "), x, F.lit('</td><td><a href="/a/'), x, F.lit('">'), x, F.lit(".htm</a></td></tr>")))
    page = F.concat(F.lit("<html><body><p>Index</p><table><tr><th>Description</th><th>Document</th></tr>"), F.array_join(tr, "\n"), F.lit("</table></body></html>"))
    pages = c.groupBy("accession_number").agg(page.alias("html"))
    return readers.html_index(pages, "accession_number", "html", ["description", "document"])


@entry("S18_session_calendar", """select strftime(d, '%Y-%m-%d') as day, epoch_us(d) + 52200000000 opens, epoch_us(d) + 75600000000 closes
    from (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-02-29', interval 1 day)) d) where isodow(d) < 6 and d not in (timestamp '2024-01-01', timestamp '2024-01-15', timestamp '2024-02-19')""")
def s18_session_calendar(spark, sf):
    return plain(readers.weekday_sessions(spark, "2024-01-01", "2024-02-29", ("2024-01-01", "2024-01-15", "2024-02-19")))


@entry("K02_atomic_publish", "select * from (values ('first', 'written'), ('again', 'reused'), ('other', 'refused'), ('read', '25')) t(step, result)")
def k02_atomic_publish(spark, sf):
    """A finished artifact is kept, one of other content refused, and readers find it whole."""
    n, path = table(spark, sf, "nation"), scratch(spark, "nation")
    out = [("first", lake.publish(n, path, [], ["n_nationkey"])), ("again", lake.publish(n, path, [], ["n_nationkey"]))]
    try:
        out.append(("other", lake.publish(n.where("n_nationkey > 3"), path)))
    except ValueError:
        out.append(("other", "refused"))
    return _told(spark, [*out, ("read", str(spark.read.parquet(path).count()))])


@entry("K03_resumed_batches", "select o_orderstatus batch, case when o_orderstatus = 'F' then 'reused' else 'written' end as result, count(*) n from orders group by 1")
def k03_resumed_batches(spark, sf):
    """Batches that were sealed by an earlier run are kept, the others written."""
    o, path = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), scratch(spark, "batches")
    lake.publish_batches(o.where("o_orderstatus = 'F'"), path, "o_orderstatus")
    done = lake.publish_batches(o, path, "o_orderstatus")
    back = spark.read.option("basePath", path).parquet(f"{path}/*").groupBy(F.col("o_orderstatus").alias("batch")).agg(rows_n())
    return done.join(back, "batch")


@entry("K04_id_shards", "select substring(sha256(doc_id::varchar), 1, 1) bucket, count(*) n, sum(n_chars)::bigint as size, greatest(1, ceil(sum(n_chars) / 20000))::bigint n_files from documents group by 1")
def k04_id_shards(spark, sf):
    return lake.id_shards(table(spark, sf, "documents"), "doc_id", "n_chars", 20_000)


@entry("K05_unique_table", "select * from (values ('orders', 'unique'), ('lineitem', 'refused')) t(step, result)")
def k05_unique_table(spark, sf):
    """A table is written only if its key is one."""
    out = []
    for name, keys in (("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey"])):
        try:
            lake.assert_unique(table(spark, sf, name), keys)
            out.append((name, "unique"))
        except ValueError:
            out.append((name, "refused"))
    return _told(spark, out)


@entry("K08_replace", "select c_custkey, case when o is null then c_mktsegment else 'ORDER ' || o end segment from customer left join (select o_custkey, max(o_orderkey) o from orders where o_orderdate >= timestamp '2000-01-01' group by 1) on o_custkey = c_custkey")
def k08_replace(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz '2000-01-01'").join(old.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    new = new.select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("ORDER "), F.col("o_orderkey").cast("string")).alias("segment"), "o_orderkey")
    return registry.replace_rows(old, new, ["c_custkey"], [F.col("o_orderkey").desc()])


@entry("K11_linked_outcomes", """with p as (select distinct o_custkey k, o_orderstatus r from orders), o as (select o_custkey k, max(o_totalprice) v from orders where o_orderpriority = '1-URGENT' group by 1)
    select r as role, case when r = 'F' then 'already_linked' when r = 'O' then 'conflict' else 'new' end status, count(*) n from p join o using (k) group by 1, 2""")
def k11_linked_outcomes(spark, sf):
    """One outcome for all roles of a key: linked ones stay, others than those linked are conflicts."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("role"), "o_totalprice", "o_orderpriority")
    outcomes = o.where("o_orderpriority = '1-URGENT'").groupBy("k").agg(F.max("o_totalprice").alias("v"))
    old = o.select("k", "role").distinct().where("role in ('F', 'O')").join(outcomes, "k").withColumn("v", F.when(F.col("role") == "O", F.col("v") + 1).otherwise(F.col("v")))
    return registry.link_outcomes(old, o, outcomes, "k", "role", "v").groupBy("role", "status").agg(rows_n())


@entry("K12_append_only", "select 'appended' as step, count(*)::varchar as result from orders where o_orderkey % 3 <> 1 union all select 'again', count(*)::varchar from orders where o_orderkey % 3 <> 1 union all select 'changed', 'refused'")
def k12_append_only(spark, sf):
    """New keys are appended, the same again adds nothing, a changed payload is refused and adds nothing."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    sealed = o.where("o_orderkey % 3 = 0")
    more = registry.append_sealed(sealed, o.where("o_orderkey % 3 <> 1"), "o_orderkey", "o_orderstatus")
    again = registry.append_sealed(more, o.where("o_orderkey % 3 = 2"), "o_orderkey", "o_orderstatus")
    out = [("appended", str(more.count())), ("again", str(again.count()))]
    try:
        registry.append_sealed(sealed, sealed.withColumn("o_orderstatus", F.lit("?")), "o_orderkey", "o_orderstatus")
        out.append(("changed", "appended"))
    except ValueError:
        out.append(("changed", "refused"))
    return _told(spark, out)


@entry("K13_packed_csv", "select o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total, strftime(max(o_orderdate), '%Y-%m-%d') last_day from orders group by 1")
def k13_packed_csv(spark, sf):
    """A packed CSV artifact, written and read again with its types."""
    path = scratch(spark, "csv-gz")
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderpriority")
    o.write.option("header", "true").option("compression", "gzip").csv(path)
    back = spark.read.option("header", "true").schema(o.schema).csv(path)
    return plain(back.groupBy("o_orderpriority").agg(rows_n(), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("day").alias("last_day")))


@entry("K14_json_report", """select o_orderpriority as name, '{"priority":"' || o_orderpriority || '","n":' || count(*) || ',"customers":' || count(distinct o_custkey) || '}' as report from orders group by 1""")
def k14_json_report(spark, sf):
    """A report as one JSON object a line."""
    per = table(spark, sf, "orders").groupBy("o_orderpriority").agg(rows_n(), F.countDistinct("o_custkey").alias("c"))
    return per.select(F.col("o_orderpriority").alias("name"), F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), "n", F.col("c").alias("customers"))).alias("report"))


@entry("K15_size_gate", "select * from (values ('small', 'within'), ('large', 'beyond'), ('none', 'absent')) t(step, result)")
def k15_size_gate(spark, sf):
    gate = lambda name, most: lake.size_gate(spark, f"{sf}/{name}.parquet", most)
    return _told(spark, [("small", gate("nation", 10_000_000)), ("large", gate("lineitem", 1)), ("none", gate("absent", 1))])


@entry("K17_mapped_import", """with m as (select ticker, min(asset_id) e from temporal_origins where ticker is not null and asset_id is not null group by 1 having count(distinct asset_id) = 1)
    select distinct evidence_claim_id, e entity from evidence_claims join m on ticker = registrant_ticker where claim_kind = 'guarantor_claim'""")
def k17_mapped_import(spark, sf):
    """Rows of an older table under new keys: unknown and ambiguous ones are left out, those that are there are not brought again."""
    c = table(spark, sf, "evidence_claims").select("evidence_claim_id", F.col("registrant_ticker").alias("ticker"), "claim_kind")
    m = table(spark, sf, "temporal_origins").select("ticker", F.col("asset_id").alias("entity")).where("entity is not null")
    return registry.mapped_import(c, m, "ticker", c.where("claim_kind <> 'guarantor_claim' or claim_kind is null"), "evidence_claim_id").select("evidence_claim_id", "entity")


@entry("K18_backfill_gate", """with g as (select count(distinct conflict_group_id) n, count(distinct conflict_group_id) filter (conflict_group_id not in (select conflict_group_id from identity_conflict_buckets where conflict_group_id is not null)) l from identity_conflict_groups),
    b as (select count(distinct conflict_bucket_id) n, count(distinct conflict_bucket_id) filter (conflict_bucket_id not in (select conflict_bucket_id from identity_conflict_evidence where dba_alias_raw is not null and conflict_bucket_id is not null)) l from identity_conflict_buckets)
    select 'buckets' as gate, n n_required, l n_lacking, case when l = 0 then 'complete' else 'incomplete' end status from g union all select 'aliases', n, l, case when l = 0 then 'complete' else 'incomplete' end from b""")
def k18_backfill_gate(spark, sf):
    g, b, e = (table(spark, sf, f"identity_conflict_{n}") for n in ("groups", "buckets", "evidence"))
    one = registry.backfill_gate(g, b, "conflict_group_id", "buckets")
    return one.unionByName(registry.backfill_gate(b, e.where("dba_alias_raw is not null"), "conflict_bucket_id", "aliases"))
