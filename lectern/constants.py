"""Numbers, patterns and word lists that results depend on."""

from __future__ import annotations

# Ranking
BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
CANDIDATE_MULTIPLIER, LEAST_CANDIDATES = 3, 10
CHAPTER_BOOST = 1.35
RECURRING_DF = 2

# Evidence and answers
MAX_EVIDENCE, CLOSEST_LIMIT = 10, 3
VERBATIM_COVERAGE = 0.22
EXCERPT_CHARS, STREAM_CHARS = 120, 14
SEARCH_LIMIT, MOST_SEARCH_LIMIT = 20, 50

# Learning
COVERAGE_WEIGHT, ENGAGEMENT_WEIGHT, ACCURACY_WEIGHT = 50.0, 25.0, 25.0
QUESTION_CAP, LEARNED_FROM = 5, 80

# Concepts, quizzes, summaries
MAX_CONCEPTS, MAX_NAME, MAX_TEXT, MAX_ANCHORS, MAX_PREREQUISITES, LEAST_PARAGRAPH = 12, 16, 300, 6, 10, 8
CHAPTER_CHARS = 8000
MAX_QUESTIONS, DISTRACTORS, LEAST_PROMPT, LEAST_NAME = 5, 3, 12, 2
SUMMARY_PARAGRAPHS, SUMMARY_CHARS, SUMMARY_CHUNKS = 8, 4000, 12

# Structure
PAGE_CHARS = 1200
FORMULA_CHARS, HEADING_CHARS = 80, 40
LOW_CONTENT_CHARS = 500
MARGIN_PAGES, MARGIN_RATIO = 3, 0.3
SPARSE_CHARS_PER_PAGE, PROBE_PAGES = 40, 12
PART_CHARS, CHUNK_CHARS, EMBEDDING_SIZE = 10_000, 500, 256
SELECTION_CHARS, SELECTION_RATIO = 4, 0.6
PAGE_HEIGHT = 660.0

# Patterns of chapters, sections and noise, as Java regular expressions
CHAPTER_TITLE = "(?i)^\\s*(第\\s*[0-9一二三四五六七八九十百]+\\s*[章篇部卷]|chapter\\s*\\d+|part\\s*\\d+|附录\\s*[A-Za-zＡ-Ｚ])"
SECTION_TITLE = "(?i)^\\s*(第\\s*[0-9一二三四五六七八九十百]+\\s*节|[0-9]+(?:\\.[0-9]+)+\\s*\\S)"
PAGE_CHAPTER_TITLE = "(?i)^\\s*(第\\s*[0-9一二三四五六七八九十百]+\\s*[章节篇]|chapter\\s*\\d+|part\\s*\\d+|附录\\s*[A-Za-zＡ-Ｚ])"
PIPELINE_CHAPTER_TITLE = "(?i)^\\s*(?:第\\s*[0-9一二三四五六七八九十百千万]+\\s*[章节篇部卷].*|[0-9]+(?:\\.[0-9]+)*\\s+[^\\s，。；：]{1,30}|chapter\\s+[0-9]+(?:\\s*[:：\\-–]\\s*.*)?)\\s*$"
NOISE_TITLE = "(?i)^(目\\s*录|contents|cover|封面|书名页|版权页|索引|参考文献|后记|致谢)$"
CJK = "[\\u4e00-\\u9fff]"
WIDE_CJK = "[\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff]"
FORMULA = "[=\\u2211\\u222b\\u2192\\u2264\\u2265]|[a-zA-Z]\\s*\\(|x\\^|_\\{"
SENTENCE_END = "[。．？！；：!?;”』」…]$"
STOP_END = "(?<!\\d)\\.\\s*$"
DOT_LEADER = "(?:\\.\\s*){5,}|…{4,}|⋯{4,}"
PAGE_NUMBER = "^[\\d\\s\\-—.·]+$"
URL_ALONE = "^(?:https?://|www\\.)\\S+$"
URL_AFTER_CJK = "(?<=[\\u4e00-\\u9fff])\\s*(?:https?://|www\\.)\\S+\\s*$"

# Words of definition sentences, for the two dialects of concept extraction
MARKERS_A = "是指|指的是|称为|叫作|叫做|被称为|就称|定义为|定义是|含义是|的意思是|表示的是"
MARKERS_B = "是指|指的是|称为|叫作|被称为|定义为|定义是|含义是|的意思是|表示的是"
NARRATIVE_STARTS = "首先|其次|如果|我们|这里|下面|因此|其中|对于|在|当|例如|另外|注意|也就是说|最后|然后|需要|假设"
FILLERS = "这个|一个|两个|某个|其|该|所谓"
NAME_QUOTES = "《》「」\"'“” \t"
NAME_END = "，。、；：,;:!?"

# Texts of answers and exports
NO_TITLE, NO_CHAPTER_TITLE = "未命名教材", "未命名章节"
IMAGE_TEXT = "（插图）"
NO_EVIDENCE_TEXT = "教材中未找到直接依据"
NO_EVIDENCE_HINT = "可以换个问法：点出教材里的具体概念（例如「导数的定义」）；或者直接选中相关原文再提问——划词追问不受依据判定限制。"
NO_MODEL_NOTICE = "（未接入大模型，这里直接给出教材中与你的问题最相关的原文，可对照核对。）"
EMPTY_REPLY_NOTICE = "（模型这次没有返回内容，先给出教材中与你的问题最相关的原文，可对照核对。）"
BOX_NOTE, DRAWING_NOTE = "个文本框", "张图片"
QUESTION_CHARS = 200
TABLE_PAGES, HEADING_PAGES = 200, 200
TASK_FIELDS = ("status", "total_pages", "done_pages", "book_id", "message", "title", "updated_at")
EVENT_KINDS = ("open", "read", "ask", "complete", "quiz")
STATUSES = ("planned", "learning", "learned")
