"""Queries on reading, settings, exports, SQL functions, stored listings and streams, each with its DuckDB SQL (None where SQL can't express it)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col as C

from ..functions import cleaning as K
from ..functions import sql as sql_functions
from ..functions import text as T
from ..operators import dedup, enrich, flow, listing, postclean, stats
from ..sources import contacts as contact_io
from ..sources import export
from ..sources.shared import shared_path
from ..streaming import jobs
from .card_queries import DUCK, built
from .contact_queries import CONTACTS, D1, DOMAIN, EMAIL_RE, J1, NORM, PLAIN, PROFILES, STRICT_TEN, VALUE, contacts, enriched, long_rows, norm, profiles
from .contact_queries import QUERIES as RULES
from .page_queries import DOMAIN as PAGE_DOMAIN
from .page_queries import PARAMS, pages

FIELDS = "row_id, name, email, phone, title, location, profile_url"


def read_again(spark, sf):
    """The contacts as two sets of files, read back."""
    d, path = contacts(spark, sf), shared_path(spark, "contacts")
    for k in (0, 1):
        d.where(C("row_id") % 2 == k).withColumn("title", F.coalesce("title", F.lit(""))).withColumnRenamed("profile_url", "profileUrl").write.parquet(f"{path}/{k}.parquet")
    return contact_io.read_contacts(spark, f"{path}/*.parquet")


def appended(spark, sf):
    """An export of the even rows with the odd ones added, as its file says."""
    d, path = contacts(spark, sf), shared_path(spark, "export")
    for k in (0, 1):
        contact_io.append_export(contact_io.export_view(d.where(C("row_id") % 2 == k), ["name", "email", "phone", "profile_url"]), path, 1000)
    return spark.read.schema("name string, email string, phone string, profile_url string").csv(path)


DEFAULT = {"card": ".card", "wait": 2, "page": {"size": 10, "kind": "auto", "retry": {"times": 3, "codes": [500, 502]}}, "tags": ["a", "b"]}


def settings(spark, sf):
    """Settings of two thirds of the sites: nested ones, lists, explicit nulls, an object in the place of a number, and text that is no JSON."""
    d = pages(spark, sf).select(listing.domain(C("url")).alias("domain")).distinct().withColumn("n", F.length("domain") % 6)
    own = F.when(C("n") == 0, F.concat(F.lit('{"card": "#'), "domain", F.lit('", "page": {"size": 25, "retry": {"codes": [429]}}, "own": {"x": 1}}'))).when(C("n") == 1, '{"wait": null, "page": {"kind": null}, "tags": []}').when(C("n") == 2, '{"page": 7, "wait": {"ms": 5}}').when(C("n") == 3, "{broken")
    return d.where("n < 4").select("domain", own.alias("settings"))


def site_config(spark, sf):
    d = contact_io.resolve_site_config(pages(spark, sf), settings(spark, sf), DEFAULT)
    at = {"card": "$.card", "wait": "$.wait", "size": "$.page.size", "kind": "$.page.kind", "times": "$.page.retry.times", "codes": "$.page.retry.codes", "tags": "$.tags", "own": "$.own.x", "ms": "$.wait.ms"}
    return d.select("page_id", "domain", *(F.get_json_object("settings", p).alias(k) for k, p in at.items()), F.contains("settings", F.lit('"wait":null')).alias("null_wait"), F.contains("settings", F.lit('"kind":null')).alias("null_kind"))


def for_export(spark, sf):
    """Contacts with lists, a time, numbers and what an enrichment says."""
    k = C("row_id")
    actions = F.map_from_arrays(F.array(*(F.lit(c) for c in ("name", "email", "phone", "title"))), F.array(F.lit("CLEANED"), F.when(k % 2 == 0, "ENRICHED").otherwise("UNCHANGED"), F.when(k % 3 == 0, "ENRICHED").otherwise("BOTH_MISSING"), F.lit("VALIDATED")))
    about = F.when(k % 7 > 0, F.struct((k * 86_461).cast("timestamp").alias("enrichedAt"), F.when(k % 7 > 1, actions).alias("actions"), F.when(k % 5 > 0, F.struct(F.lit("high").alias("overall"))).alias("confidence")))
    lists = F.when(k % 4 > 0, F.array("title", "name"))
    return contacts(spark, sf).withColumns({"education": lists, "bar_admissions": F.when(k < 0, lists), "seen_at": (k * 3_601).cast("timestamp"), "score": (k / 2).cast("double"), "confidence": F.lit("row"), "extra": F.struct("title"), "_inner": F.lit("x"), "enrichment": about})


FORMATTED = ["name", "phone", "education", "seenAt", "score", "profileUrl", *export.ENRICHMENT_COLUMNS]
TIME = "strftime(make_timestamp({t} * 1000000), '%b %-d, %Y %-I:%M %p')"
CHOICES = {"default": {}, "core": {"core": True, "enrichment": True}, "every": {"every": True}, "enriched": {"enrichment": True, "exclude": ["email"]}, "named": {"columns": ["score", "bar_admissions", "education", "actionsSummary", "name"]}}
HEADED = {
    "default": "Name|Email|Phone|Title|Profile URL", "core": "Name|Email|Phone|Title|Profile URL|Location", "every": "Name|Email|Phone|Title|Profile URL|Location|Education|Confidence|Score|Seen At",
    "enriched": "Name|Phone|Title|Profile URL|Actions|Confidence|Enriched At|Fields Cleaned|Fields Enriched", "named": "Name|Education|Actions|Score",
}


def choices(spark, sf):
    """Headers by way of choosing, with how many values the first of them has."""
    d = for_export(spark, sf)
    parts = [d.agg(F.lit(k).alias("choice"), F.lit("|".join(export.export_table(d, **how).columns)).alias("headers"), F.count("name").alias("names")) for k, how in CHOICES.items()]
    return listing.union_pages(parts)


def called_in_sql(spark, sf):
    sql_functions.register(spark, "cl_")
    return spark.sql(
        """select row_id, array_join(cl_extract_emails(email), ',') as emails, cl_normalize_phone(phone) as keep, cl_normalize_phone_strict(phone) as strict, cl_display_phone(phone) as display,
 cl_is_valid_name(name) as valid_name, cl_validate_name(name) as checked_name, cl_name_from_email(email) as guessed, cl_presence_confidence(name, email, phone) as level, cl_clean_name(name).value as clean_name, cl_clean_location(location).value as clean_location,
 cl_email_domain(email) as domain, cl_domain_type(cl_email_domain(email)) as kind from {d}""", d=contacts(spark, sf),
    )


def in_columns(spark, sf):
    """The same by Columns, for the test that holds them against one another."""
    d = contacts(spark, sf)
    e, p, n = C("email"), C("phone"), C("name")
    return d.select(
        "row_id", F.array_join(T.extract_emails(e), ",").alias("emails"), T.normalize_phone(p).alias("keep"), T.normalize_phone(p, "strict").alias("strict"), T.normalize_phone(p, "display").alias("display"),
        T.is_valid_name(n).alias("valid_name"), T.validate_name(n).alias("checked_name"), T.name_from_email(e).alias("guessed"), T.presence_confidence(n, e, p).alias("level"), K.clean_name(n)["value"].alias("clean_name"), K.clean_plain(C("location"))["value"].alias("clean_location"),
        T.email_domain(e).alias("domain"), T.domain_type(T.email_domain(e)).alias("kind"),
    )


def unfolded_in_sql(spark, sf):
    sql_functions.register(spark, "cl_", ["url_parameters"])
    return spark.sql("select page_id, p.position as pos, p.name, p.value from {d}, lateral cl_url_parameters(url) as p", d=pages(spark, sf))


def stored(spark, sf):
    """Listings of stored pages: page 3 of odd listings shows page 1 again, pages 5 and 6 of each seven are empty, others have mail links."""
    d = built(spark, sf, "select distinct k div 8 as p from x").select("p", (C("p") % 3).alias("listing_id"), (F.floor(C("p") / 3) + 1).alias("page_num"))
    shown = F.when((C("page_num") == 3) & (C("listing_id") == 1), 1).otherwise(C("page_num"))
    who = F.concat_ws("-", F.lit("n"), C("listing_id").cast("string"), shown.cast("string"))
    body = F.concat(*(F.concat(F.lit("<a href='mailto:"), who, F.lit(f"-{i}@x.co'>"), who, F.lit(f" {i}</a>")) for i in range(3)))
    html_ = F.when((C("page_num") % 7).isin(5, 6), "<html><body><p>Nobody here</p></body></html>").otherwise(F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")))
    return d.select(C("p").alias("page_id"), "listing_id", "page_num", F.lit("https://x.co/l").alias("url"), html_.alias("html"))


STORED = """pg as (select distinct k // 8 as p from x), st as (select p % 3 as listing_id, p // 3 + 1 as page_num, (p // 3 + 1) % 7 not in (5, 6) and not (p // 3 + 1 = 3 and p % 3 = 1) as valid from pg)"""


def profile_rows(spark, sf):
    """Profiles with lists, on some."""
    n = F.length("profile_url")
    return profiles(spark, sf).withColumns({"education": F.when(n % 3 > 0, F.array(F.lit("Law"), "name")), "practice_areas": F.when(n % 2 == 0, F.array().cast("array<string>")), "bio": F.when(n % 5 > 0, F.concat(F.lit("About "), "name"))})


def with_lists(spark, sf):
    d = contacts(spark, sf).withColumn("education", F.when(C("row_id") % 4 == 0, F.array(F.lit("Own"))).when(C("row_id") % 4 == 1, F.array().cast("array<string>")))
    return enrich.enrich(d, profile_rows(spark, sf))


def merge_details(spark, sf):
    """A row per contact and field of the audit and the details."""
    m = enrich.enrichment_metadata(enriched(spark, sf))
    d = m.select("row_id", F.explode("details").alias("field", "x"), "audit").where("field <> 'bio'")
    return d.select("row_id", "field", C("x.old").alias("old"), C("x.new").alias("new"), C("x.action").alias("action"), C("x.source").alias("source"), C("x.note").alias("note"), F.map_contains_key("audit", C("field")).alias("kept"), F.try_element_at("audit", C("field")).alias("original"))


def scraped(spark, sf):
    """Contacts with a level and a source of their own."""
    k = C("row_id")
    return contacts(spark, sf).withColumns({"confidence": F.when(k % 3 == 0, "high").when(k % 3 == 1, "low"), "source": F.when(k % 2 == 0, "html").when(k % 5 == 0, "pdf").otherwise("merged")})


def streamed(spark, sf, job, mode="append"):
    """What a job over the contacts, arriving in three parts, has put out in the end; by row_id parts, the latest row of each."""
    path = shared_path(spark, "arriving")
    d = contacts(spark, sf)
    for k in range(3):
        d.where(F.floor(C("row_id") / 40) % 3 == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    def put(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/{n}")

    job(source).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out/*")


def best_streamed(spark, sf):
    d = streamed(spark, sf, jobs.stream_best, "update")
    last = d.groupBy("dedup_key").agg(F.max_by(F.struct("row_id", "first_row", "name", "email"), "batch").alias("b"))
    return last.select("b.*")


def fuzzy_streamed(spark, sf):
    """D3's verdicts on contacts that arrive in order, in three parts."""
    path = shared_path(spark, "arriving")
    d = contacts(spark, sf)
    edges = d.approxQuantile("row_id", [0.33, 0.67], 0.05)
    for k, (a, b) in enumerate(zip([-1, *edges], [*edges, 1 << 60], strict=True)):
        d.where((C("row_id") > int(a)) & (C("row_id") <= int(b))).write.parquet(f"{path}/in/{k}")
        source = spark.readStream.schema(d.schema).parquet(f"{path}/in/*")
        jobs.stream_fuzzy_table(source, path, f"{path}/state").awaitTermination()  # each part is a run of its own, from the checkpoint
    return spark.read.parquet(f"{path}/verdicts").drop("batch")


def errors(spark, sf):
    return contacts(spark, sf).where("row_id % 2 = 0").select("row_id", F.when(C("email").isNull(), "no_email").when(C("phone").isNull(), "no_phone").otherwise("other").alias("type"), F.concat(F.lit("row "), C("row_id").cast("string")).alias("message"))


QUERIES = {
    "s1_read_contacts": (read_again, f"{CONTACTS} select {FIELDS} from contacts"),
    "s3_site_config": (
        site_config,
        f"""with d as (select page_id, {PAGE_DOMAIN} as domain from pages), n as (select *, length(domain) % 6 as n from d)
 select page_id, domain, case when n = 0 then '#' || domain else '.card' end as card, case when n = 1 then null when n = 2 then '{{"ms":5}}' else '2' end as wait, case when n = 0 then '25' when n = 2 then null else '10' end as size, case when n in (1, 2) then null else 'auto' end as kind,
 case when n = 2 then null else '3' end as times, case when n = 0 then '[429]' when n = 2 then null else '[500,502]' end as codes, case when n = 1 then '[]' else '["a","b"]' end as tags, case when n = 0 then '1' end as own, case when n = 2 then '5' end as ms, n = 1 as null_wait, n = 1 as null_kind from n""",
    ),
    "s4_write_contacts": (
        lambda s, d: contact_io.write_contacts(contacts(s, d), shared_path(s, "written"), "test", "parquet"),
        f"{CONTACTS}, {DOMAIN} select count(*) as total, count(email) as with_email, count(phone) as with_phone, count(distinct domain) as domains, count(*) filter (domain_type = 'business') as business, count(*) filter (domain_type = 'personal') as personal, 'test' as source from doms",
    ),
    "s6_append_export": (appended, f"{CONTACTS} select name, email, {norm('phone', 'else phone')} as phone, profile_url from contacts"),
    "s7_rebased_pattern": (
        lambda s, d: listing.rebased_pattern(pages(s, d).select(listing.domain(C("url")).alias("domain"), F.when(C("page_id") % 2 == 0, "page").otherwise("ref").alias("name"), F.lit("https://old.example/").alias("base_url"), C("page_id").alias("cached_at"), (C("page_id") * 7 % 101).alias("confidence")), pages(s, d)),
        rf"""with {PARAMS}, dm as (select page_id, url, {PAGE_DOMAIN} as domain from pages), ch as (select domain, max(page_id) as last_at from dm where page_id * 7 % 101 >= 70 group by 1), pt as (select domain, case when last_at % 2 = 0 then 'page' else 'ref' end as name from ch),
 q as (select prm.page_id, string_agg(url_encode(prm.name) || '=' || url_encode(value), '&' order by pos) as q from prm join dm using (page_id) join pt on pt.domain = dm.domain where prm.name <> pt.name group by 1)
 select page_id, url, name, regexp_replace(url, '\?.*', '') || coalesce('?' || q, '') as base_url, true as changed from dm join pt using (domain) left join q using (page_id)""",
    ),
    "c29_format_columns": (
        lambda s, d: export.format_columns(for_export(s, d), FORMATTED),
        f"""{CONTACTS}, e as (select *, row_id % 7 > 0 as has_e, row_id % 7 > 1 as has_a from contacts) select row_id, coalesce(name, '') as name, coalesce({norm('phone', 'else phone')}, '') as phone, case when row_id % 4 > 0 then coalesce(title, '') || ', ' || name else '' end as education,
 {TIME.format(t="(row_id * 3601)")} as "seenAt", case when row_id % 2 = 0 then (row_id // 2)::varchar else (row_id / 2)::double::varchar end as score, coalesce(profile_url, '') as "profileUrl", case when has_e then {TIME.format(t="(row_id * 86461)")} else '' end as "enrichedAt",
 case when has_e and has_a then 'name:CLEANED' || case when row_id % 2 = 0 then ', email:ENRICHED' else '' end || case when row_id % 3 = 0 then ', phone:ENRICHED' else '' end || ', title:VALIDATED' else '' end as "actionsSummary", case when has_e and row_id % 5 > 0 then 'high' else '' end as confidence,
 case when not has_e then '' when has_a then ((row_id % 2 = 0)::int + (row_id % 3 = 0)::int)::varchar else '0' end as "fieldsEnrichedCount", case when not has_e then '' when has_a then '1' else '0' end as "fieldsCleanedCount" from e""",
    ),
    "c30_select_export_columns": (choices, f"{CONTACTS}, ch(choice, headers) as (values {', '.join(f'({k!r}, {v!r})' for k, v in HEADED.items())}) select choice, headers, (select count(name) from contacts) as names from ch"),
    "p4_sql_functions": (
        called_in_sql,
        "select row_id, c1.emails, c3.keep, c3.strict, c3.display, c4.valid as valid_name, c5.value as checked_name, c6.value as guessed, c7.level, cn.value as clean_name, cl.value as clean_location, c10.domain, c10.kind from "
        + " join ".join(f"({RULES[q][1]}) {a}{' using (row_id)' if a != 'c1' else ''}" for a, q in (("c1", "c1_extract_emails"), ("c3", "c3_normalize_phone"), ("c4", "c4_is_valid_name"), ("c5", "c5_validate_name"), ("c6", "c6_name_from_email"), ("c7", "c7_presence_confidence"), ("c10", "c10_email_domain"), ("cn", "c17_clean_name")))
        + f" join ({CONTACTS}, {PLAIN} select row_id, v as value from cl) cl using (row_id)",
    ),
    "p4_table_functions": (unfolded_in_sql, f"with {PARAMS} select page_id, pos, name, value from prm"),
    "w1_stored_listings": (lambda s, d: postclean.stored_listings(stored(s, d)), f"with {DUCK}, {STORED} select listing_id, page_num, valid from st"),
    "w1_stored_boundary": (
        lambda s, d: listing.page_boundary(postclean.stored_listings(stored(s, d))),
        f"""with {DUCK}, {STORED}, e as (select listing_id, min(page_num) as last_page from st a where page_num <= 500 and valid and not exists (select 1 from st b where b.listing_id = a.listing_id and b.valid and b.page_num in (a.page_num + 1, a.page_num + 2)) group by 1)
 select distinct st.listing_id, coalesce(last_page, 0) as last_page, coalesce(last_page, 0) < 499 as confirmed, coalesce(last_page, 0) >= 500 as capped from st left join e on e.listing_id = st.listing_id""",
    ),
    "j1_profile_lists": (
        lambda s, d: with_lists(s, d).select("row_id", F.array_join("education", "|").alias("education"), F.size("practice_areas").alias("areas"), C("merged_bio.value").alias("bio"), C("merged_bio.action").alias("action")),
        f"""{CONTACTS}, {PROFILES}, j as (select c.row_id, p.profile_url is not null as hit, length(p.profile_url) as n, p.name from contacts c left join profiles p on c.profile_url = p.profile_url)
 select row_id, case when row_id % 4 = 0 then 'Own' when row_id % 4 = 1 then '' when hit and n % 3 > 0 then 'Law|' || name end as education, case when hit and n % 2 = 0 then 0 end::int as areas, case when hit and n % 5 > 0 then 'About ' || name end as bio, case when hit and n % 5 > 0 then 'ENRICHED' else 'UNCHANGED' end as action from j""",
    ),
    "j1a_merge_details": (
        merge_details,
        f"""{J1}, v as (select *, {VALUE} as v, case when action in ('CLEANED', 'REPLACED') or (action = 'ENRICHED' and o is not null) then o end as original from act), t as (select j.row_id, n_dirty and n_title is not null as taken, n_title from j),
 nm as (select row_id, action = 'CLEANED' as cleaned from act where field = 'name')
 select v.row_id, v.field, o as old, case when v.field = 'title' and v is null and t.taken and nm.cleaned then 'Partner' else v end as new, action, case when action in ('VALIDATED', 'UNCHANGED') then 'original' else 'profile' end as source,
 case when v.field = 'title' and v is null and t.taken and nm.cleaned then 'extracted from the name''s end' end as note, original is not null or (action = 'ENRICHED' and o is null) as kept, original from v join t using (row_id) join nm using (row_id)""",
    ),
    "a1_scrape_stats": (
        lambda s, d: stats.contact_stats(dedup.dedup_contacts(scraped(s, d)).drop("first_row"), scraped(s, d), pages(s, d)),
        f"""{CONTACTS}, {D1}, u as (select * from y where rn = 1) select count(*) as total, count(email) as with_email, count(phone) as with_phone, count(*) filter (email is not null and phone is not null) as with_both, count(*) filter (full_ = 3) as complete,
 count(*) filter (row_id % 3 = 0) as high, 0::bigint as medium, count(*) filter (row_id % 3 = 1) as low, count(*) filter (row_id % 2 = 0) as from_html, count(*) filter (row_id % 2 = 1 and row_id % 5 = 0) as from_pdf, count(*) filter (row_id % 2 = 1 and row_id % 5 > 0) as from_merged,
 (select count(*) from pages) as pages_scraped, (select count(*) from contacts) as total_extracted, (select count(*) from contacts) - count(*) as duplicates_removed from u""",
    ),
    "a2_more_personal_domains": (
        lambda s, d: stats.domain_stats(contacts(s, d), contacts(s, d).select(F.concat(F.lit("WWW.Firm"), (C("row_id") % 3).cast("string"), F.lit(".com ")).alias("domain"))),
        f"""{CONTACTS}, {DOMAIN}, k as (select domain, contacts, case when domain in ('firm0.com', 'firm1.com', 'firm2.com') then 'personal' else domain_type end as t from perdom)
 select sum(contacts)::bigint as parsed, count(*) as unique_domains, count(*) filter (t = 'business') as business_domains, coalesce(sum(contacts) filter (t = 'business'), 0)::bigint as business_contacts, coalesce(sum(contacts) filter (t = 'personal'), 0)::bigint as personal_contacts, (select count(email) from contacts) as with_email from k""",
    ),
    "a7_contacts_by_action": (lambda s, d: stats.contacts_by_action(long_rows(s, d)), f"{J1}, w as (select row_id, " + ", ".join(f"bool_or(action = '{k}') as {k.lower()}" for k in ("ENRICHED", "VALIDATED", "CLEANED", "REPLACED")) + " from act group by 1) select count(*) as processed, " + ", ".join(f"count(*) filter ({k}) as {k}" for k in ("enriched", "validated", "cleaned", "replaced")) + " from w"),
    "a7_flag_counts": (lambda s, d: stats.flag_counts(long_rows(s, d)), f"{J1} select field || '_mismatch' as flag, count(*) as contacts from act where action = 'REPLACED' group by 1"),
    "a8_enrichment_rate": (lambda s, d: stats.enrichment_rate(enriched(s, d)), f"{CONTACTS}, {PROFILES} select count(*) as total, count(p.profile_url) as enriched, round(count(p.profile_url) / count(*), 4) as rate from contacts c left join profiles p on c.profile_url = p.profile_url"),
    "a12_error_summary": (
        lambda s, d: stats.error_summary(errors(s, d)).select("type", "errors", F.array_join("samples", "|").alias("samples")),
        f"""{CONTACTS}, er as (select row_id, case when email is null then 'no_email' when phone is null then 'no_phone' else 'other' end as type from contacts where row_id % 2 = 0), k as (select *, row_number() over (partition by type order by row_id) as rn from er)
 select type, count(*) as errors, string_agg('row ' || row_id, '|' order by row_id) filter (rn <= 5) as samples from k group by 1""",
    ),
    "c20_titles_match": (
        lambda s, d: contacts(s, d).select("row_id", K.titles_match(F.when(C("row_id") % 3 == 0, "of  COUNSEL").when(C("row_id") % 3 == 1, " of counsel ").otherwise(C("title")), F.when(C("row_id") % 2 == 0, "Of Counsel").otherwise("partner")).alias("same")),
        f"{CONTACTS} select row_id, case when row_id % 3 = 0 then false when row_id % 3 = 1 then row_id % 2 = 0 else coalesce(title = 'Partner', false) and row_id % 2 = 1 end as same from contacts",
    ),
    "c23_only_noise": (
        lambda s, d: contacts(s, d).select("row_id", K.is_only_noise(F.regexp_replace("name", "(?i)view profile|[a-z]{4,}", "")).alias("noise")),
        f"{CONTACTS} select row_id, length(trim(regexp_replace(name, '(?i)view profile|[a-z]{{4,}}', '', 'g'))) < 2 as noise from contacts",
    ),
    "p1_stages": (
        lambda s, d: flow.contact_pipeline(contacts(s, d), skip=("enrich", "post_clean"))["contacts"].select("row_id", "email", "phone"),
        f"{CONTACTS}, {D1} select row_id, lower(nullif(regexp_extract(email, '{EMAIL_RE}'), '')) as email, {NORM.replace('{d}', STRICT_TEN).replace('{rest}', '')} as phone from y where rn = 1",
    ),
    "t1_stream_best": (best_streamed, f"{CONTACTS}, {D1} select row_id, first_row, name, email from y where rn = 1"),
    "t2_stream_fuzzy": (fuzzy_streamed, None),
}
