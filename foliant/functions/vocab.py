"""Word lists, patterns and thresholds that decide results."""

from __future__ import annotations

# Text patterns. (?U) makes \s and \d cover all of Unicode.
MONEY = r"(?iU)(?<!\d)(?:[$€£¥]|USD|CNY|RMB)?\s*-?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?(?!\d)"
PERCENT_MONEY = r"(?iU)(?<!\d)(?:[$€£¥]|USD|CNY|RMB)?\s*-?\d{1,3}(?:,\d{3})*(?:\.\d+)?%?(?!\d)"
DATE_YMD = r"(?U)(\d{4})\s*[年/\-.]\s*(\d{1,2})\s*[月/\-.]\s*(\d{1,2})\s*日?"
DATE_MDY = r"(?U)(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})"
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
MOBILE = r"1[3-9]\d{9}"
PHONE = r"(?U)\+?\d[\d\-\s()]{6,}\d"
CN_ID = r"\b\d{17}[0-9Xx]\b|\b\d{15}\b"
INVOICE_NUMBER = r"(?iU)(?:invoice\s*(?:no|#|number)?|发票号码|票据编号|单号)[:：]?\s*([A-Z0-9\-]{4,})"
CHECKBOX = r"☑|☒|☐|□|✅|✔|✓|\[[xX ]\]|\([xX ]\)|○|◯"
KEY_VALUE = r"(?U)^[^:：]{1,40}[:：]\s*\S+"
AMOUNT_LINE = r"(?U)\d[\d,.]*\s*$"
BIRTH_DATE = r"(?U)(?:date\s+of\s+birth|dob|出生日期|出生)"
PAGE_NUMBER = r"(?iU)^(?:page\s+\d+(?:\s+of\s+\d+)?|\d+|[-–—]?\s*\d+\s*[-–—]?|第\s*\d+\s*页)$"
LIST_BULLET = r"(?U)^([-*•·●○◦])\s*"
LIST_ORDERED = r"(?U)^((?:\(\d+\)|\d+[.)]|[A-Za-z][.)]|[一二三四五六七八九十]+[、.]|（[一二三四五六七八九十]+）))\s*"
HEADING_NUMBER = r"(?U)^(\d+(?:\.\d+){0,3})[.)]?\s+"
HEADING_CHAPTER = r"(?U)^第[一二三四五六七八九十百千0-9]+[章节部分篇]\s*"
HEADING_SECTION = r"(?U)^[一二三四五六七八九十]+[、.]\s*"
HEADING_SUBSECTION = r"(?U)^（[一二三四五六七八九十]+）\s*"
SIGNATURE = r"(?i)(signature|signed by|signature of|authorized signature|applicant signature|签名|签字|申请人签名|授权签字)"
FIELD_HINT = r"(?i)(name|date|address|phone|email|id|applicant|notes?|comments?|姓名|日期|地址|电话|手机|邮箱|证件|备注)"
LINE_NOISE = r"[?_]{2,}|[|]{2,}|[_]{3,}"
EVIDENCE_DATE = r"(?U)\d{4}\s*[年/\-.]\s*\d{1,2}\s*[月/\-.]\s*\d{1,2}\s*日?|\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{4}"

# Form fields, their labels, markers and canonical values.
FORM_FIELDS = ("name", "date", "address", "phone", "email", "id_number", "gender")
FIELD_ALIASES = {
    "name": ("applicant name", "full name", "name", "申请人姓名", "申请人", "姓名"),
    "date": ("registration date", "application date", "date", "日期", "登记日期", "申请日期"),
    "address": ("mailing address", "residential address", "contact address", "address", "联系地址", "通讯地址", "住址", "地址"),
    "phone": ("mobile phone", "telephone", "phone", "mobile", "tel", "联系电话", "手机号", "手机", "电话"),
    "email": ("e-mail", "email", "邮箱", "电子邮箱"),
    "id_number": ("id number", "id no", "identification number", "身份证号", "身份证", "证件号"),
    "gender": ("sex", "gender", "性别"),
}
CHECKED = ("☑", "☒", "✅", "✔", "✓", "[x]", "[X]", "(x)", "(X)")
GENDERS = {"男": "male", "male": "male", "m": "male", "女": "female", "female": "female", "f": "female"}
OPTIONS = {"男": "male", "male": "male", "女": "female", "female": "female", "是": "yes", "yes": "yes", "否": "no", "no": "no"}

# Receipts and invoices.
TOTAL_WORDS = ("grand total", "amount due", "total due", "total", "合计", "总计", "应付")
SUBTOTAL_WORDS = ("subtotal", "sub total", "net amount", "小计")
TAX_WORDS = ("tax", "vat", "gst", "sales tax", "税额", "税金", "增值税")
INVOICE_WORDS = ("invoice", "tax invoice", "发票", "invoice no")
RECEIPT_WORDS = ("receipt", "sales receipt", "收据", "小票")
ITEM_COLUMNS = {
    "description": ("item", "items", "description", "product", "service", "name", "项目", "品名", "商品", "描述"),
    "quantity": ("qty", "quantity", "q'ty", "数量"),
    "unit_price": ("unit price", "price", "rate", "单价"),
    "amount": ("amount", "total", "line total", "金额", "小计"),
}
VENDOR_WORDS = ("ltd", "llc", "inc", "corp", "co.", "company", "store", "mart", "cafe", "restaurant", "pharmacy", "market", "trading")
NOT_VENDOR_WORDS = ("invoice", "receipt", "tax", "total", "date", "phone", "tel", "email", "address", "qty", "amount", "price")
LINE_ITEM_SKIP_WORDS = ("subtotal", "sub total", "tax", "vat", "gst", "total", "amount due", "invoice", "receipt", "date", "change", "cash")
SUMMARY_WORDS = ("subtotal", "sub total", "tax", "vat", "gst", "total", "amount due", "合计", "总计", "税额", "小计")
TRANSACTION_COLUMNS = {
    "date": ("date", "posting date", "交易日期", "日期"),
    "description": ("description", "details", "memo", "摘要", "交易说明", "对方户名"),
    "debit": ("debit", "withdrawal", "paid out", "支出", "借方"),
    "credit": ("credit", "deposit", "paid in", "收入", "贷方"),
    "amount": ("amount", "transaction amount", "金额", "发生额"),
    "balance": ("balance", "余额"),
}
OPENING_WORDS = ("opening balance", "beginning balance", "期初余额")
CLOSING_WORDS = ("closing balance", "ending balance", "期末余额", "余额")
BANK_WORDS = ("bank statement", "account statement", "statement period", "transaction", "balance", "银行流水", "账户明细", "交易明细", "余额")

# Routing.
LABELS = ("invoice", "receipt", "form", "report", "id")
PIPELINES = {
    "invoice": ("recognition", "layout_reader", "table_to_csv", "receipt_invoice_extractor"),
    "receipt": ("recognition", "layout_reader", "table_to_csv", "receipt_invoice_extractor"),
    "form": ("recognition", "layout_reader", "table_to_csv", "form_to_json"),
    "report": ("recognition", "layout_reader", "table_to_csv"),
    "id": ("recognition", "layout_reader", "table_to_csv", "form_to_json"),
}
ITEM_HEADER_HINTS = ("item", "items", "description", "qty", "quantity", "price", "amount", "品名", "数量", "单价", "金额")
TOTAL_HINTS = ("total", "grand total", "amount due", "合计", "总计", "应付")
TAX_HINTS = ("tax", "vat", "gst", "税额", "税金", "增值税")
INVOICE_HINTS = ("invoice", "tax invoice", "invoice no", "invoice #", "发票", "发票号码", "票据编号")
RECEIPT_HINTS = ("receipt", "sales receipt", "收据", "小票")
FORM_HINTS = ("form", "application", "registration", "applicant", "signature", "申请表", "登记表", "申请人", "签名")
REPORT_HINTS = ("report", "summary", "introduction", "conclusion", "overview", "analysis", "报告", "摘要", "引言", "结论")
ID_HINTS = ("identity card", "id card", "national id", "resident identity card", "passport", "driver license", "driver's license", "身份证", "身份证号", "居民身份证", "护照", "驾驶证", "签发机关", "nationality", "sex", "gender", "date of birth", "dob", "姓名", "出生日期")
STARTERS = {
    "invoice": ("invoice", "tax invoice", "invoice no", "invoice #", "发票", "发票号码"),
    "receipt": ("receipt", "sales receipt", "收据", "小票"),
    "form": ("application form", "registration form", "application", "form", "申请表", "登记表", "申请人"),
    "report": ("report", "analysis report", "summary", "overview", "annual report", "quarterly report", "报告", "分析报告", "摘要"),
    "id": ("identity card", "id card", "passport", "resident identity card", "身份证", "居民身份证", "护照"),
}
SHORT_LABELS = ("invoice", "receipt", "form", "id")
PDF_EXTENSIONS = (".pdf",)
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")

# Questions about fields.
INTENT_ALIASES = {
    "total_amount": ("total amount", "grand total", "amount due", "total due", "总金额", "总额", "合计", "总计", "应付金额"),
    "tax_amount": ("tax amount", "tax", "vat", "gst", "税额", "税金", "增值税"),
    "subtotal_amount": ("subtotal", "sub total", "小计"),
    "contract_start_date": ("contract start date", "start date", "effective date", "commencement date", "合同起始日", "合同开始日期", "合同生效日", "生效日期", "起始日"),
    "contract_end_date": ("contract end date", "end date", "expiration date", "expiry date", "termination date", "合同结束日", "合同终止日", "合同到期日", "到期日"),
    "signing_date": ("signing date", "signed on", "execution date", "签署日期", "签订日期"),
    "invoice_number": ("invoice number", "invoice no", "invoice #", "发票号码", "票据编号", "单号"),
    "vendor": ("vendor", "seller", "merchant", "store", "商户", "卖方", "供应商"),
    "party_a": ("party a", "甲方"),
    "party_b": ("party b", "乙方"),
    "document_date": ("date", "document date", "invoice date", "receipt date", "日期", "单据日期"),
    "name": ("name", "applicant name", "full name", "姓名", "申请人姓名"),
    "address": ("address", "mailing address", "住址", "地址"),
    "phone": ("phone", "telephone", "mobile", "联系电话", "手机号", "电话"),
    "email": ("email", "e-mail", "邮箱", "电子邮箱"),
    "id_number": ("id number", "identification number", "身份证号", "证件号"),
    "gender": ("gender", "sex", "性别"),
}
LINE_PATTERNS = {
    "total_amount": ("total", "grand total", "amount due", "合计", "总计", "应付"),
    "tax_amount": ("tax", "vat", "gst", "税额", "税金", "增值税"),
    "subtotal_amount": ("subtotal", "sub total", "小计"),
    "contract_start_date": ("start date", "effective date", "commencement", "起始日", "生效日期", "开始日期"),
    "contract_end_date": ("end date", "expiration", "expiry", "termination", "到期日", "结束日期", "终止日期"),
    "signing_date": ("signing date", "signed on", "execution date", "签署日期", "签订日期"),
    "invoice_number": ("invoice no", "invoice #", "invoice number", "发票号码", "票据编号", "单号"),
}
LINE_LABELS = {
    "party_a": ("party a", "甲方"),
    "party_b": ("party b", "乙方"),
    "name": ("name", "姓名"),
    "address": ("address", "地址", "住址"),
    "phone": ("phone", "mobile", "telephone", "电话", "手机号"),
    "email": ("email", "e-mail", "邮箱"),
    "id_number": ("id number", "identification", "身份证", "证件号"),
    "gender": ("gender", "sex", "性别"),
}
CONTRACT_FIELDS = ("contract_title", "contract_number", "party_a", "party_b", "signing_date", "effective_date", "end_date", "total_amount")
CONTRACT_PATTERNS = {
    "contract_title": r"(?iU)(service agreement|employment agreement|consulting agreement|lease agreement|nda|non-disclosure agreement|contract|agreement|合同|协议)",
    "contract_number": r"(?iU)(?:contract\s*(?:no|#|number)|agreement\s*(?:no|#|number)|合同编号|合同号|协议编号)[:：]?\s*([A-Z0-9\-_/]{4,})",
    "party_a": r"(?iU)(?:party\s*a|甲方)[:：]?\s*(.+)$",
    "party_b": r"(?iU)(?:party\s*b|乙方)[:：]?\s*(.+)$",
    "signing_date": r"(?iU)(?:signing\s*date|signed\s*on|签署日期|签订日期)[:：]?\s*(.+)$",
    "effective_date": r"(?iU)(?:effective\s*date|start\s*date|commencement\s*date|生效日期|起始日期|开始日期)[:：]?\s*(.+)$",
    "end_date": r"(?iU)(?:end\s*date|expiration\s*date|expiry\s*date|termination\s*date|到期日期|结束日期|终止日期)[:：]?\s*(.+)$",
    "total_amount": r"(?iU)(?:contract\s*amount|total\s*amount|contract\s*value|总金额|合同总价|合同金额)[:：]?\s*(.+)$",
}
CONTRACT_HINTS = ("contract", "agreement", "party a", "party b", "甲方", "乙方", "协议", "合同", "effective date", "start date")

# Evidence and chart questions.
EVIDENCE_STOPWORDS = ("the", "is", "are", "what", "when", "where", "which", "who", "how", "much", "many", "please", "tell", "me", "是多少", "是什么", "哪天", "哪里", "什么")
EVIDENCE_INTENTS = {
    "amount": ("total", "amount", "value", "price", "fee", "cost", "总金额", "金额", "总价", "合同金额"),
    "date": ("date", "effective", "start", "end", "signed", "日期", "起始", "开始", "结束", "签署", "签订"),
    "party": ("party", "vendor", "customer", "甲方", "乙方", "供应商", "客户"),
    "summary": ("summary", "overview", "摘要", "概述", "总结"),
}
CHART_HINTS = ("chart", "figure", "graph", "trend", "growth", "revenue", "sales", "metric", "图表", "图", "趋势", "增长", "收入", "销售")
CHART_STOPWORDS = ("the", "is", "are", "which", "what", "highest", "lowest", "largest", "smallest", "total", "sum", "trend", "最大", "最高", "最低", "最小", "合计", "总计", "趋势", "是多少", "哪个")
CHART_INTENTS = {
    "max": ("highest", "largest", "max", "maximum", "最高", "最大"),
    "min": ("lowest", "smallest", "min", "minimum", "最低", "最小"),
    "total": ("total", "sum", "合计", "总计", "总和"),
    "trend": ("trend", "increase", "decrease", "变化", "趋势", "增长", "下降"),
}
DIMENSION_WORDS = ("region", "category", "year", "month", "quarter", "name", "地区", "类别", "年份", "月份", "季度")

# Robustness profiles and export names.
LAYERS = ("ocr", "layout", "extraction", "reasoning")
VARIANTS = {
    "scan_low_contrast": (0.58, 0.35, 0.42, 0.28),
    "skew": (0.44, 0.64, 0.50, 0.30),
    "shadow": (0.62, 0.42, 0.46, 0.32),
    "curved": (0.50, 0.68, 0.55, 0.35),
    "screen_capture": (0.54, 0.38, 0.43, 0.40),
    "blur": (0.74, 0.48, 0.55, 0.42),
}
STAGES = ("classification", "splitting", "ocr_layout_extraction", "chunking", "qa_summary", "human_review", "robustness", "exports")
IMPORTANT_FIELDS = ("name", "date", "phone", "address", "id_number")
LOW_CONFIDENCE = 85.0
QUEUE_LIMIT = 120
CIRCLES = ("o", "O", "0", "○", "◯", "●", "◦")
LINE_CHARACTERS = "|_-=—–"
