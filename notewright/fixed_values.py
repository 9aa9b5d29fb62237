"""Values that results depend on: word lists, patterns, labels and limits.

Everything in this file is a fixed value of the data formats this library works
on. Results change when an entry changes, so they are kept together, as text.
"""

# ---- fixed values: clinical notes -------------------------------------------------

# Workbook columns of a raw note.
NOTE_COLUMNS = {
    "content": "病历内容",
    "template": "病历模板类型",
    "diagnosis": "诊断",
    "patient": "患者ID",
    "admission": "入院时间",
}

# Sheet name of the note workbook -> department key, in sheet order.
DEPARTMENTS = {
    "产科": "obstetrics",
    "儿科": "pediatrics",
    "神经内科": "neurology",
}

PATIENT_ID_WIDTH = 12
SCENARIO_PREFIX = "emr-"
DAILY_SCENARIO = "emr-日常病程记录"

# Removed from notes one after the other; the first contains the second.
BOILERPLATE = (
    "表格<会诊表格>内容:会诊意见:会诊时间: 年 月 日时分",
    "表格<会诊表格>内容:会诊意见:",
    "会诊医师职称 会诊意见:会诊时间:",
    "主诉，继续当前治疗，密观患者病情变化。",
    "主诉，考虑暂时观察。密观。",
    "主诉，嘱其伤口三日勿沾水。",
)
STOP_PHRASE = "拆线前伤口勿沾水。"
STAMP = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\s(?:[01]\d|2[0-3]):[0-5]\d"
MIN_NOTE_LENGTH = 10
MAX_NOTE_LENGTH = 200

# De-identification, rule by rule; in rules marked "dotall" the dot crosses lines.
REQUEST_FORM = "表格<申请表格>内容:"
NEWBORN_HEADER = r"姓名[：:].+?转科时间[：:]\d{4}年\d{2}月\d{2}日"  # dotall
NAME_BLOCK = r"姓名[：:].+?性别[：:][男女]年龄[：:]\S+(?:科室[：:].+?床号[：:]\S+)?"
PHONES = r"科室联系电话[：:]\S+\s*医务处联系电话[：:]\S+"
FATHER = r"父姓名[：:].*?(?=母姓名)"  # dotall
MOTHER = r"母姓名[：:][^。\n]*"
OPERATOR = r"操作(?:者|医师)[：:].*?(?:。|(?=记录者)|$)"
GUIDANCE = r"以上处理是在.{0,30}?指导下进行的[。.]?\s*"
RECORDER = r"记录者[：:][^\n]*"
PHYSICIAN = r"无?医师签字[：:][^\n]*"
SIGNATURE_LABEL = r"(?:申请|会诊)医师签名[：:]\s*"
DOUBLE_COMMA = r"[，,]\s*[，,]"
WIDE_GAP = r"[ 　]{2,}"
BLANK_LINES = r"\n{3,}"
MIN_NAME_LENGTH = 2

# ---- fixed values: reports and phenotype strings ----------------------------------

NO_PHENOTYPE = ("正常无表型", "正常表型", "-")
PHENOTYPE_SEPARATORS = "；。，,、"
RESULT_SENTINEL = "分析结果："
SHORT_TABLE_ROWS = 4
BODY_START = 6
BODY_START_SECOND_TABLE = 2
LAST_BODY_ROW = 99
DESCRIPTION_CELL = (3, 0)
IDENTIFYING_FIELDS = 4

# ---- fixed values: term dictionary -------------------------------------------------

TERM_ID_COLUMN = "HPO编号"
TERM_NAME_COLUMN = "中文翻译"
TERM_PREFIX = "HP:"
NO_TRANSLATION = "未找到中文翻译"

# ---- fixed values: scoring and review ----------------------------------------------

METHODS = ("bert", "tagger", "fasthpocr", "pbtagger", "real", "rag_hpo", "base")
NESTED_METHODS = ("base",)
TRUTH_KEYS = (
    "patient_phenotypes",
    "family_phenotypes",
    "patient_phenotypes_neg",
    "family_phenotypes_neg",
)
UNKNOWN = "unknown"

# ---- fixed values: literature pages --------------------------------------------------

MISSING_TITLE = "未找到题目"
MISSING_ABSTRACT = "未找到摘要"
UNTITLED = "untitled"
SITE1_HOST = "https://rs.yiigle.com"
SITE2_HOST = "https://www.yiigle.com"
RESULTS_PER_DISEASE = 2
PARTS = (1, 2, 4)

NO_RESULT_TEXTS = {
    "site1": ("未找到", "无结果", "没有找到", "No results", "暂无数据"),
    "site2": ("没有找到", "未找到", "无结果", "0 条结果"),
}
NO_RESULT_CLASSES = ("no-result", "empty-result", "no-data")

TITLE_SELECTORS = (
    "h1", ".article-title", ".title", ".paper-title", "header h1", ".detail-title",
    '[class*="title"]',
)
TITLE_META = ("citation_title", "og:title")
ABSTRACT_SELECTORS = {
    "site1": (".abstract", ".summary", ".zhaiyao", ".content p", ".detail p", ".article-content p"),
    "site2": (
        ".abstract", ".abstract-content", ".article-abstract", ".zhaiyao",
        '[class*="abstract"]', '[class*="Abstract"]', ".summary", ".content",
    ),
}
ABSTRACT_WORD = "摘要"
ABSTRACT_KEYWORDS = ("ABSTRACT", "摘要", "Abstract")
ABSTRACT_META = ("citation_abstract", "description", "og:description")
MAIN_SELECTORS = ("article", ".article-content", ".main-content", ".content")
RESULT_SELECTORS = (
    ".s_searchResult_li", ".search-result-item", ".result-item", ".article-item", ".list-item",
    'div[class*="result"]', 'div[class*="item"]',
)
RESULT_TITLE_SELECTOR = ".s_searchResult_li_title"
RESULT_BUTTON_SELECTOR = ".s_searchResult_li_button_r"
RESULT_ITEM_CLASS = "w_search_item"
RESULT_LINK_MARK = "cmaid"
LINK_NOISE = ("搜索", "登录", "注册", "首页")
LINK_SCAN = 50
LINK_TEXT_BAND = (10, 200)
PDF_MARKS = ("pdf", "download")
PDF_MIN_BYTES = 2000

LENGTHS = {
    "title": 5, "item": 10, "abstract": 50, "body": 100, "line": 10,
    "result_title": 150, "page_title": 200, "body_cut": 500, "preview": 200, "error": 200,
}
DISEASE_SUFFIXES = {"type": "型", "syndrome": "综合征", "disorder": "症"}

# ---- fixed values: article text files --------------------------------------------------

ARTICLE_LABELS = {
    "title": "题目: ", "abstract": "摘要: ", "disease": "疾病名称: ", "disease_id": "疾病ID: ",
    "url": "来源URL: ", "time": "提取时间: ", "status": "状态: ", "error": "错误: ",
}
DETAIL_UNREACHABLE = "无法访问详情页"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# ---- fixed values: inference ---------------------------------------------------------------

ATTEMPTS = 3
POOL_RATE = 10
PROMPT_SLOT = "{description}"
ANNOTATION_PROMPT = """# 你是一个医学领域的专业助手，擅长从文本中提取HPO表型信息。

## 给定文本
{description}

## 任务描述
请标注出这段文字中包含的HPO表型，遵循以下原则：
1. 排除所有阴性的表型，如“无XXX”、“未见XXX”等。
2. 保留所有待定的表型，如“可能存在XXX”、“疑似XXX”、“未排除XXX”、“XXX不除外”等。
3. 使用标准的HPO、CHPO名称和对应的HPO_ID进行标注。
4. 如果文本中没有提及任何患者相关的表型，请返回空结果。
5. 对于重复的表型不要列出多次。

## 输出格式
按照json格式返回，格式如下：
[[HPO_ID, 标准英文HPO术语名称, 标准CHPO术语名称, 术语在原文中的描述]]"""
