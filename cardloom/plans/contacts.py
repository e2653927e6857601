"""Contacts and profiles derived from the customer table, for queries at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = """f(i, fname) as (values (0,'Arthur'),(1,'Jane'),(2,'Robert'),(3,'Maria'),(4,'Wei'),(5,'Sofia'),(6,'John')),
l(i, lname) as (values (0,'Adler'),(1,'Doe'),(2,'Brown'),(3,'Smith'),(4,'Chen'),(5,'Lopez'),(6,'Meyer'),(7,'Stone'),(8,'Okafor'),(9,'Rossi'),(10,'Kim')),
g(i, city, area) as (values (0,'New York, NY','212'),(1,'Chicago','312'),(2,'London','20'),(3,'Frankfurt','69'),(4,'Washington, D.C.','202'),(5,'Boston, MA','617')),
base as (
 select c_custkey as k, fname, lname, city, area,
        '+1-' || area || '-555-' || substr(cast(10000 + c_custkey % 10000 as varchar(9)), 2, 4) as us_phone
 from customer join f on c_custkey % 7 = f.i join l on c_custkey % 11 = l.i join g on c_custkey % 6 = g.i),
r(rep) as (values (0),(1))"""

CONTACTS = f"""with {BASE},
contacts as (select k * 2 + rep as row_id,
 case when k % 5 = 0 then fname || ' ' || lname || 'Partner' when k % 13 = 0 then fname || ' ' || lname || ', JD'
      when k % 97 = 0 then 'View Profile' else fname || ' ' || lname end as name,
 case when k % 6 = 5 then null when rep = 1 and k % 20 = 3 then upper(fname) || '.' || lower(lname) || cast(k % 400 as varchar(9)) || '@FIRM' || cast(k % 17 as varchar(9)) || '.com' when k % 9 = 0 then upper(fname) || '.' || lname || cast(k % 50 as varchar(9)) || '@GMAIL.com'
      else lower(fname) || '.' || lower(lname) || cast(k % 400 as varchar(9)) || '@firm' || cast(k % 17 as varchar(9)) || '.com' end as email,
 case when k % 8 = 3 or (rep = 0 and k % 30 = 3) then null when k % 4 = 1 then '(' || area || ') 555-' || substr(us_phone, length(us_phone) - 3, 4) else us_phone end as phone,
 case when k % 3 = 0 then 'Partner' else null end as title,
 case when k % 7 = 2 then city || chr(10) || us_phone when k % 11 = 4 then city || chr(10) || 'Frankfurt' else city end as location,
 case when k % 10 = 9 then null else 'https://firm' || cast(k % 17 as varchar(9)) || '.com/people/' || lower(fname) || '-' || lower(lname) || '-' || cast(k % 400 as varchar(9)) end as profile_url
from base cross join r where rep = 0 or k % 10 = 3)"""

PROFILES = """profiles as (select 'https://firm' || cast(k % 17 as varchar(9)) || '.com/people/' || lower(fname) || '-' || lower(lname) || '-' || cast(k % 400 as varchar(9)) as profile_url,
 max(fname || ' ' || lname) as name,
 max(case when k % 50 = 7 then 'wrong@firm.com' else lower(fname) || '.' || lower(lname) || cast(k % 400 as varchar(9)) || '@firm' || cast(k % 17 as varchar(9)) || '.com' end) as email,
 max(us_phone) as phone, 'Partner' as title, max(city) as location
from base where k % 10 <> 9 and k % 4 <> 2 group by 1)"""


def customers(spark: SparkSession, sf_dir: str, rows: int = 20_000) -> DataFrame:
    """The customers' keys, dealt out by key. The file that holds them is small and would be read by a task or two, which then did all work up
    to the first shuffle; so every core gets a part of them, and a part has about `rows` keys at most."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    n = keys.count()
    return keys.repartition(max(min(spark.sparkContext.defaultParallelism, n // 100 + 1), -(-n // rows)), "c_custkey")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"{CONTACTS} select * from contacts".replace("from customer ", "from {customer} "), customer=customers(spark, sf_dir))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = f"with {BASE}, {PROFILES} select * from profiles"
    return spark.sql(sql.replace("from customer ", "from {customer} "), customer=customers(spark, sf_dir))
