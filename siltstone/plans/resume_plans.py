"""Résumés, made of customers and their orders, and sections of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import resumes as R
from siltstone.sources.tables import dealt, read

#: Headings that every fifth line of a document becomes, by turns; the last two are none.
HEADS = ["Summary", "WORK EXPERIENCE:", "-- Education --", "Technical Skills", "Experience", "about us", "Experience."]
#: The month in which dates that go on are read.
AS_OF = "2001-06-15"


def _chosen(choices: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(number, F.lit(len(choices))) + 1).cast("int"))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of all documents."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 2, _chosen(HEADS, F.col("doc_id") + F.floor(i / 5))).otherwise(x))
    rows = read(spark, sf, "documents").select("doc_id", R.parts(F.array_join(lines, "\n")).alias("parts"))
    return rows.select("doc_id", F.explode("parts").alias("part", "body")).select("doc_id", "part", F.sha2("body", 256).alias("body_sha256"), F.length("body").cast("long").alias("n_chars"))


def _worked(form: int, begin: Column, end: Column) -> Column:
    if form == 0:
        return F.concat(F.lit("Engineer, "), F.date_format(begin, "MMM yyyy"), F.lit(" - "), F.date_format(end, "MMMM, yyyy"))
    if form == 1:
        return F.concat(F.date_format(begin, "M/yyyy"), F.lit(" to "), F.date_format(end, "MM/yyyy"), F.lit(" at a bank"))
    if form == 2:
        return F.concat(F.date_format(begin, "yyyy"), F.lit("–"), F.date_format(end, "yyyy"))
    return F.concat(F.lit("Since "), F.date_format(begin, "MMM. yyyy"), F.lit(" till  Date"))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """A line of work for each order of a customer: so many months from its date, in one of four forms."""
    k = F.col("o_orderkey")
    begin, end = F.to_date("o_orderdate"), F.add_months(F.to_date("o_orderdate"), (k % 17).cast("int") - 2)
    said = _worked(3, begin, end)
    for form in (2, 1, 0):
        said = F.when((k % 29 != 0) & (k % 3 == form), _worked(form, begin, end)).otherwise(said)
    return read(spark, sf, "orders").select("o_custkey", k, said.alias("line"))


def experience_months(spark: SparkSession, sf: str) -> DataFrame:
    """Months of all of a customer's work, overlaps once."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n")
    rows = _orders(spark, sf).groupBy(F.col("o_custkey").alias("custkey")).agg(text.alias("text"))
    ranges = rows.select("custkey", R.date_ranges(F.col("text"), F.lit(AS_OF).cast("date")).alias("r"))
    return ranges.select("custkey", F.size("r").cast("long").alias("n_ranges"), R.covered_months(F.col("r")).cast("long").alias("months"))


FIRST, SECOND = ["Asha", "Ravi", "Mary Ann", "Li"], ["Rao", "Iyer", "Smith", "May"]
CITIES = ["Pune, Maharashtra", "Oslo, Norway", "New York, NY, USA"]
_HEADLINES = ["Software Engineer", "Lover of tea", "Data Analyst | SQL"]


def _people(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    who = F.concat(_chosen(FIRST, k), F.lit(" "), _chosen(SECOND, F.floor(k / 4)))
    number = F.concat(F.lit("98765"), F.lpad((k % 100_000).cast("string"), 5, "0"))
    mail = F.concat(F.lit("p."), k.cast("string"), F.lit("@mail.example.com"))
    shown = F.when(k % 3 == 0, F.concat(F.lit("+91 "), number)).when(k % 3 == 1, F.concat(number, F.lit(" 2019-2023"))).otherwise("phone 12345")
    years = F.when(k % 4 > 0, F.concat((k % 13).cast("string"), F.lit("+ years of experience."))).otherwise("New here.")
    work = F.when(k % 5 > 0, F.concat(F.lit("\nEXPERIENCE\nEngineer, Jan 2019 - Dec "), (F.lit(2019) + k % 4).cast("string"), F.lit("\n2018 - 2019"))).otherwise("")
    text = F.concat(
        F.lit("Résumé 2024\r\n"), who, F.lit("\r\n"), _chosen(_HEADLINES, k), F.lit("\r\n"), _chosen(CITIES, k), F.lit(" | "), mail, F.lit(" | "), shown, F.lit("\nlinkedin.com/in/p-"), k.cast("string"),
        F.lit("\nSummary\nBuilds things in asp.net with "), F.element_at(F.split(who, " "), -1), F.lit(". "), years, work, F.lit("\nEducation\nB.Tech"),
    )
    return read(spark, sf, "customer").select(k.alias("custkey"), who.alias("who"), mail.alias("mail"), number.alias("number"), text.alias("text"))


def resume_fields(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(_people(spark, sf), "custkey").select("custkey", R.fields(F.col("text"), F.lit(AS_OF).cast("date")).alias("f")).select("custkey", "f.*")


def redacted_resumes(spark: SparkSession, sf: str) -> DataFrame:
    rows = dealt(_people(spark, sf), "custkey")
    return rows.select("custkey", R.redacted(F.col("text"), F.col("who"), F.col("mail"), F.col("number")).alias("text"))


QUERIES = {"txt10_sections": sections, "dat07_experience_months": experience_months, "txt08_resume_fields": resume_fields, "txt07_redacted": redacted_resumes}
_HEAD = "case (doc_id + (i - 1) // 5) % 7 " + " ".join(f"when {n} then '{h}'" for n, h in enumerate(HEADS)) + " end"
_PEOPLE = """with p as (select c_custkey as k, ['Asha', 'Ravi', 'Mary Ann', 'Li'][(c_custkey % 4 + 1)::int] as a, ['Rao', 'Iyer', 'Smith', 'May'][(c_custkey // 4 % 4 + 1)::int] as b, '98765' || lpad((c_custkey % 100000)::varchar, 5, '0') as number,
    ['Software Engineer', 'Lover of tea', 'Data Analyst | SQL'][(c_custkey % 3 + 1)::int] as head, ['Pune, Maharashtra', 'Oslo, Norway', 'New York, NY, USA'][(c_custkey % 3 + 1)::int] as city from customer),
  q as (select *, case when k % 4 > 0 then k % 13 || '+ years of experience.' else 'New here.' end as years, case when k % 5 > 0 then E'\\nEXPERIENCE\\nEngineer, Jan 2019 - Dec ' || (2019 + k % 4) || E'\\n2018 - 2019' else '' end as work from p)
  """
ORACLE_SQL = {
    "txt10_sections": f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
      m as (select doc_id, i, case when (i - 1) % 5 = 2 then {_HEAD} else x end as x from l),
      h as (select doc_id, i, x, case when length(x) <= 48 and not ends_with(x, '.') and not contains(x, '@') then case trim(regexp_replace(lower(x), '[^a-z]+', ' ', 'g')) when 'summary' then 'SUMMARY' when 'work experience' then 'EXPERIENCE' when 'experience' then 'EXPERIENCE'
        when 'education' then 'EDUCATION' when 'technical skills' then 'OTHER' end end as head from m),
      c as (select *, max(case when head is not null then i end) over (partition by doc_id order by i) as above from h),
      p as (select c.doc_id, c.i, c.x, c.head is not null as is_head, a.head as part from c join h a on a.doc_id = c.doc_id and a.i = c.above),
      b as (select doc_id, part, coalesce(string_agg(x, chr(10) order by i) filter (not is_head), '') as body from p group by 1, 2)
      select doc_id, part, sha256(body) as body_sha256, length(body)::bigint as n_chars from b""",
    "dat07_experience_months": f"""with o as (select o_custkey, o_orderkey as k, o_orderdate::date as b, (o_orderdate::date + to_months((o_orderkey % 17)::int - 2))::date as e from orders),
      r as (select o_custkey, case when k % 29 <> 0 and k % 3 = 2 then year(b) * 12 else year(b) * 12 + month(b) - 1 end as f,
        case when k % 29 = 0 then {2001 * 12 + 5} when k % 3 = 2 then year(e) * 12 + 11 else year(e) * 12 + month(e) - 1 end as l from o),
      v as (select *, max(l) over (partition by o_custkey order by f, l rows between unbounded preceding and 1 preceding) as upto from r where f <= l),
      n as (select o_custkey, count(*) as n_ranges, sum(greatest(0, l - greatest(coalesce(upto, -1), f - 1)))::bigint as months from v group by 1)
      select c.o_custkey as custkey, coalesce(n_ranges, 0) as n_ranges, coalesce(months, 0) as months from (select distinct o_custkey from orders) c left join n on n.o_custkey = c.o_custkey""",
    "txt08_resume_fields": _PEOPLE
    + """select k as custkey, a || ' ' || b as name, 'p.' || k || '@mail.example.com' as email, case k % 3 when 0 then '+91 ' || number when 1 then number end as phone, city as place, case when k % 3 = 0 then head end as headline,
      'linkedin.com/in/p-' || k as linkedin, null::varchar as github, case when k % 4 > 0 then (k % 13)::double end as years, case when k % 5 > 0 then (24 + 12 * (k % 4))::int end as months,
      'Builds things in asp.net with ' || b || '. ' || years as summary from q""",
    "txt07_redacted": _PEOPLE
    + """select k as custkey, E'Résumé 2024\\n[CANDIDATE]\\n' || head || E'\\n' || city || ' | [EMAIL] | ' || case k % 3 when 0 then '[PHONE]' when 1 then '[PHONE] 2019-2023' else 'phone 12345' end || E'\\n[LINK]'
      || E'\\nSummary\\nBuilds things in asp.net with ' || case when b = 'May' then b else '[CANDIDATE]' end || '. ' || years || work || E'\\nEducation\\nB.Tech' as text from q""",
}
