"""Stand-in views over the given tables, as SQL that Spark and DuckDB both run.

They turn the synthetic tables into notes, reports, pages and logs on which every
rule applies to some rows. Each view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notewright.operators.scaling import dealt, spread
from notewright.sources.scratch import scratch_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {}

# notes with a scenario, for filters and sampling
VIEWS["v_notes"] = """
select event_id as idx, user_id as patient_id,
  case event_id % 3 when 0 then 'obstetrics' when 1 then 'pediatrics' else 'neurology' end as department,
  case when event_type in ('view', 'click') then 'emr-日常病程记录' else concat('emr-', event_type) end as scenario,
  concat(case when event_id % 11 = 0 then '2024-01-05 08:30 ' else '' end,
    case when event_id % 7 = 0 then '表格<会诊表格>内容:会诊意见:' else '' end,
    '姓名：患者', cast(user_id as varchar(20)), '性别：男年龄：', cast(event_id % 90 as varchar(20)), '岁 ',
    event_type, '，  ，', case when event_id % 13 = 0 then '拆线前伤口勿沾水。' else '病情平稳，继续观察' end,
    case when event_id % 5 = 0 then '操作者：张三主治医师。' else '' end, '记录者：李四') as description
from events
"""

# raw notes on which every de-identification rule and every boilerplate phrase applies
VIEWS["v_notes_full"] = """
select event_id as idx, user_id as patient_id, event_type,
  concat(case when event_id % 11 = 0 then '2024-01-05 08:30 ' else '' end,
    case event_id % 8 when 0 then '表格<会诊表格>内容:会诊意见:会诊时间: 年 月 日时分' when 1 then '表格<会诊表格>内容:会诊意见:'
      when 2 then '会诊医师职称 会诊意见:会诊时间:' when 3 then '主诉，继续当前治疗，密观患者病情变化。'
      when 4 then '主诉，考虑暂时观察。密观。' when 5 then '主诉，嘱其伤口三日勿沾水。' else '' end,
    case when event_id % 4 = 0 then '表格<申请表格>内容:' else '' end,
    case when event_id % 6 = 1 then concat('姓名：赵某之 性别：日龄：产日', chr(10), '出生日期：某日 转科时间：2023年07月13日') else '' end,
    case when event_id % 6 = 2 then concat('姓名:程某性别:女年龄:', cast(event_id % 90 as varchar(20)), '岁科室:儿科普通病房床号:012 ') else '' end,
    case when event_id % 5 = 0 then concat('科室联系电话：82000001 医务处联系电话：82000002', chr(10)) else '' end,
    case when event_id % 5 = 1 then '父姓名：杨某，年龄：43岁，籍贯：某省，母姓名：高某，年龄：40岁。' else '' end,
    '张小明', event_type, '，  ，张小好转  　继续', chr(10), chr(10), chr(10), chr(10),
    case event_id % 3 when 0 then concat('操作医师：刘某副主任医师 /徐某', chr(10))
      when 1 then '操作者：傅某主治医师，杨某副主任医师。' else '操作者：吴某主任医师' end,
    case when event_id % 7 = 0 then '以上处理是在王某总住院医师指导下进行的。 ' else '' end,
    '记录者：李四/王五', chr(10), case when event_id % 2 = 0 then '无' else '' end, '医师签字：张三', chr(10),
    '会诊医师签名： 完 ') as description
from events
"""

# workbook rows before standardisation
VIEWS["v_raw_notes"] = """
select idx as row_no,
  case idx % 3 when 0 then ' 产科' when 1 then '儿科' else '神经内科　' end as sheet,
  case when idx % 19 = 0 then '  ' when idx % 23 = 0 then null else description end as content,
  case when idx % 10 = 0 then null when idx % 4 = 1 then '日常病程记录'
    else concat(' ', event_type, '　') end as template,
  case idx % 6 when 0 then null when 1 then ' NaN ' when 2 then '  ' else concat(' ', event_type, '病　') end as diagnosis,
  case when idx % 29 = 0 then concat('12345678901234', cast(patient_id as varchar(20)))
    else cast(patient_id as varchar(20)) end as patient,
  case when idx % 5 = 0 then null else concat('2024-01-', lpad(cast(1 + idx % 28 as varchar(20)), 2, '0')) end as admission
from v_notes_full
"""

# long form of truth and predictions; orders without lines are empty sets
VIEWS["v_eval_terms"] = """
select o.o_orderkey as idx, o.o_orderpriority as source, o.o_orderstatus as department,
  l.l_partkey % 20 as term,
  case when l.l_returnflag <> 'N' then 1 else 0 end as is_truth,
  case when l.l_quantity > 20 then 1 else 0 end as is_pred_a,
  case when l.l_discount > 0.04 then 1 else 0 end as is_pred_b
from orders o left join lineitem l on o.o_orderkey = l.l_orderkey
"""

# report rows with a phenotype string; row 0 is the patient
VIEWS["v_report_rows"] = """
select cast((event_id - event_id % 5) / 5 as bigint) as report_id, event_id % 5 as row_no,
  case when event_id % 9 = 5 then '正常无表型' when event_id % 9 = 6 then ' - ' when event_id % 9 = 7 then null
    else concat('表型', cast(user_id % 30 as varchar(20)), '；表型', cast(event_id % 17 as varchar(20)),
      case when event_id % 2 = 0 then '、' else '，' end, ' 表型', cast(user_id % 30 as varchar(20)), '。') end as phenotypes
from events
"""

# one row per table row of a report document; every fourth document has its body in a second table
VIEWS["v_table_rows"] = """
select doc, p, case when doc % 4 = 0 and r >= 4 then 2 else 1 end as tab,
  case when doc % 4 = 0 and r >= 4 then r - 4 else r end as row_no,
  case when r = 8 and doc % 5 <> 1 then '分析结果：无' when r = 3 then concat('说明', cast(doc as varchar(20)))
    else concat('格', cast(r as varchar(20)), '-0') end as c0,
  concat('合并', cast(p as varchar(20))) as c12,
  case when p % 4 = 0 then concat('合并', cast(p as varchar(20))) else concat('格', cast(r as varchar(20)), '-3') end as c3
from (select cast((event_id - event_id % 10) / 10 as bigint) as doc, event_id % 10 as r, user_id as p from events) x
"""

# disease list lines
VIEWS["v_disease_raw"] = """
select p_partkey + 1 as id, p_partkey % 5 as part,
  case when p_partkey % 50 = 0 then '  '
    when p_partkey % 6 = 0 then concat(' ', p_name, ' (OMIM:', cast(100000 + p_partkey as varchar(20)), ')')
    when p_partkey % 6 = 1 then concat(p_name, '（OMIM:', cast(100000 + p_partkey as varchar(20)), '）')
    when p_partkey % 6 = 2 then concat(p_name, '综合征') when p_partkey % 6 = 3 then concat(p_name, '症（', p_type, '(x)')
    when p_partkey % 6 = 4 then concat('综合征', p_name, '/<', p_brand, '>: .综合征')
    else concat(p_name, cast(p_size as varchar(20)), '型') end as line
from part
"""

# term dictionary rows; the last row of an id wins
VIEWS["v_term_dict"] = """
select p_partkey as row_no,
  concat(case when p_partkey % 2 = 0 then 'HP:' else '' end, lpad(cast(p_partkey % 1500 as varchar(20)), 7, '0')) as hpo_id,
  case when p_partkey % 17 = 0 then '未找到中文翻译' when p_partkey % 31 = 0 then null
    else concat('术语', cast(p_partkey as varchar(20))) end as zh
from part
"""

# ids found in texts
VIEWS["v_extracted"] = """
select event_id as idx, 0 as pos, concat('HP:', lpad(cast(event_id % 2500 as varchar(20)), 7, '0')) as hpo_id from events
union all
select event_id as idx, 1 as pos, concat('HP:', lpad(cast(user_id % 2500 as varchar(20)), 7, '0')) as hpo_id from events
"""

# output of a term tagger: a header, then tab-separated lines
VIEWS["v_tagged"] = """
select event_id as idx, concat('HPO ID', chr(9), 'Phenotype name', chr(10),
  'HP:', lpad(cast(event_id % 2500 as varchar(20)), 7, '0'), chr(9), event_type, chr(9), '1', chr(10),
  case when event_id % 3 = 0 then concat('HP:', lpad(cast(user_id % 2500 as varchar(20)), 7, '0'), chr(10)) else '' end,
  case when event_id % 4 = 0 then concat('  ', chr(10)) else '' end,
  case when event_id % 5 = 0 then concat('MP:0000001', chr(9), 'x', chr(10)) else '' end,
  'HP:', lpad(cast(user_id % 2500 as varchar(20)), 7, '0'), chr(9), event_type) as tagged
from events
"""

# annotation log; the first submission of an id counts
VIEWS["v_submissions"] = """
select event_id as seq, 2 * (event_id % 2000) as idx,
  case when event_id % 13 = 0 then false when event_id % 7 = 0 then null else true end as is_sure
from events
"""

# terms a reviewer entered
VIEWS["v_entered"] = """
select event_id as idx, case event_id % 4 when 0 then concat('术语', cast(event_id as varchar(20)))
  when 1 then concat(' 术语', cast(user_id as varchar(20)), '　') when 2 then event_type
  else concat('术语', cast(event_id % 1000 as varchar(20))) end as term
from events
"""

# answers of an annotation model: fenced, plain and broken
VIEWS["v_answers"] = """
select event_id as idx, case event_id % 5
  when 0 then concat('```json', chr(10), '[["HP:', lpad(cast(user_id % 900 as varchar(20)), 7, '0'), '", "', event_type, '", "术语", "原文"], ["HP:0000001", "All", "全部", "x"]]', chr(10), '```')
  when 1 then concat('[["HP:', lpad(cast(user_id % 900 as varchar(20)), 7, '0'), '", "', event_type, '"], ["HP:', lpad(cast(user_id % 900 as varchar(20)), 7, '0'), '", "again", "又", "y"]]')
  when 2 then '[]' when 3 then concat('no json: ', event_type) else null end as response
from events
"""

# pages with the parts that the plain table lacks
VIEWS["v_pages_full"] = """
select page_id, url, case page_id % 6 when 0 then replace(replace(h, '<h1>', '<h5>'), '</h1>', '</h5>')
    when 1 then replace(replace(h, '<h1>', '<span class="box-title">'), '</h1>', '</span>')
    when 3 then replace(replace(h, '<h1>', '<div class="lead article-title">'), '</h1>', '</div>')
    when 5 then replace(replace(h, '<h1>', '<h5>'), '</h1>', '</h5>') else h end as html
from (select page_id, url, replace(html, '<article>', concat(
  case when page_id % 2 = 0 then '<meta name="citation_title" content="Meta title of the page">' else '' end,
  case when page_id % 3 = 0 then concat('<meta name="description" content="', repeat('Meta description. ', 4), '">') else '' end,
  case when page_id % 4 = 0 then concat('<div class="abstract">', repeat('Abstract sentence. ', cast(1 + page_id % 5 as int)), '</div>') else '' end,
  case when page_id % 4 = 1 then concat('<div class="summary">', repeat('Summary sentence. ', 4), '</div>') else '' end,
  case when page_id % 5 = 0 then '<a href="//cdn.example.com/a.PDF">full text</a>' when page_id % 5 = 1 then '<a href="/files/b.pdf">PDF</a>'
    when page_id % 5 = 2 then '<a href="files/c.pdf">x</a>' when page_id % 5 = 3 then '<a href="https://x.example.com/get?id=4">Download</a>'
    else '<a onclick="location.href = ''/detail?cmaid=5''">onclick item title</a>' end,
  case when page_id % 6 = 2 then concat('<iframe src="/view/', cast(page_id as varchar(20)), '.pdf"></iframe>') else '' end,
  case when page_id % 7 = 0 then concat('<p>摘要：', repeat('正文内容', 5), '</p>') when page_id % 7 = 1 then '<p>未找到</p>'
    when page_id % 7 = 2 then '<p>no RESULTS</p>' when page_id % 7 = 3 then '<p class="box no-data">-</p>' else '' end,
  '<article>')) as h from pages) x
"""

# result lists: even pages as on site 1, odd pages as on site 2 (or none at all)
VIEWS["v_search_pages"] = """
select page_id, url, replace(html, '<article>', concat(
  case when page_id % 2 = 0 then concat(
    '<div class="w_search_item"><h1><a href="/a">First of ', url, '</a></h1><a href="/p?cmaid=', cast(page_id as varchar(20)), '&amp;x=1">全文</a></div>',
    case when page_id % 4 = 0 then '<div class="w_search_item"><h1>No link here</h1></div>' else '' end,
    case when page_id % 3 = 0 then concat('<div class="w_search_item big"><a href="p?cmaid=2', cast(page_id as varchar(20)), '">全文</a></div>') else '' end,
    '<div class="w_search_item"><h1><b>Last</b> item</h1><a href="https://x.example.com/p?cmaid=3">全文</a></div>')
  else '' end,
  case page_id % 8
    when 1 then concat('<div class="s_searchResult_li"><p class="s_searchResult_li_title"><a href="//h.example.com/d1">Title one of ', url,
      '</a></p><span class="s_searchResult_li_button_r"><a href="/q', cast(page_id as varchar(20)), '.pdf">PDF</a><a>-</a></span></div><div class="s_searchResult_li"><a href="/d2">abc</a></div>',
      '<div class="s_searchResult_li"><a href="/d3">Third title</a></div>')
    when 3 then '<div class="list-item">Plain text of an item</div><div class="list-item">short</div>'
    when 5 then '<div class="my-items"><a onclick="location.href = ''/detail?cmaid=5''">Title by click</a></div><div class="my-items">no link</div>'
    else '' end,
  '<article>')) as html
from pages
"""

# payloads and their declared types
VIEWS["v_payloads"] = """
select doc_id, case when doc_id % 5 = 0 then concat('%PDF-1.4 ', text) else text end as body,
  case when doc_id % 7 = 0 then 'Application/PDF' when doc_id % 7 = 1 then null else 'text/html' end as content_type
from documents
"""

# Views that need a different spelling per engine.
SPARK_ONLY = {
    "v_cells": """
select doc, tab, row_no, c as col_no, case c when 0 then c0 when 3 then c3 else c12 end as cell
from v_table_rows lateral view explode(array(0, 1, 2, 3)) x as c
""",
}
DUCKDB_ONLY = {
    "v_cells": """
select doc, tab, row_no, c as col_no, case c when 0 then c0 when 3 then c3 else c12 end as cell
from (select *, unnest([0, 1, 2, 3]) as c from v_table_rows) x
""",
}
NEEDS = {"v_raw_notes": ("v_notes_full",), "v_cells": ("v_table_rows",)}


def with_views(sql: str) -> str:
    """DuckDB text of a query with the views it names as common table expressions."""
    texts = VIEWS | DUCKDB_ONLY
    wanted: list[str] = []
    for name in texts:
        if name in sql.replace(",", " ").replace(")", " ").replace("(", " ").split():
            wanted += [n for n in (*NEEDS.get(name, ()), name) if n not in wanted]
    if not wanted:
        return sql
    ctes = ", ".join(f"{n} as ({texts[n]})" for n in wanted)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"


# Tables that feed work that is heavy per row.
SPREAD = ("documents", "pages", "events", "orders")
# Tables that a view joins by these keys, the largest last.
JOINED = {"v_eval_terms": {"orders": "o_orderkey", "lineitem": "l_orderkey"}}


class Inputs:
    """The given tables and the stand-in views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        df = self.read(name)
        return spread(df) if name in SPREAD else df

    def sides(self, view: str) -> dict[str, DataFrame]:
        """The tables that a view joins, dealt by their keys; rows are counted from the files' footers."""
        keys = JOINED.get(view, {})
        read = {table: self.read(table) for table in keys}
        if not read:
            return {}
        return dict(zip(keys, dealt(read[list(keys)[-1]].count(), *[(read[table], key) for table, key in keys.items()]), strict=True))

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        text = (VIEWS | SPARK_ONLY)[name]
        words, sides = set(text.replace("(", " ").replace(")", " ").split()), self.sides(name)
        for table in TABLES:
            if table in words:
                (sides[table] if table in sides else self.table(table)).createOrReplaceTempView(table)
        for view in NEEDS.get(name, ()):
            self(view).createOrReplaceTempView(view)
        return self.spark.sql(text)

    def scratch(self, name: str) -> str:
        """A new folder for what a query writes."""
        return scratch_path(self.spark, name)
