"""Words and limits that results must reproduce exactly."""

# Issue table wording.
TOTALS_BAD = "总分校验不平"
TOTALS_BAD_WHITELISTED = "总分不平 (白名单指标)"
TOTALS_ADJUSTED_SUFFIX = " - 费用调整"
TOTALS_SOURCE = "总分校验"
NO_DATA_DETAIL = "不应有数"
READBACK_PREFIX = "写入核对不符"
READBACK_NO_REGION = "：缺少地区工作表"
READBACK_NO_PERIOD = "：缺少月份列"
READBACK_NO_CODE = "：缺少指标行"
READBACK_EMPTY = "：时序值为空"
READBACK_NOT_FINITE = "：时序值异常"
READBACK_DIFFERS = "：金额不一致"
BACKFILL_SOURCE = "会计补录"
BACKFILL_DETAIL = "已补录费用数据"
PARENT_SOURCE = "会计父项补录"
PARENT_DETAIL = "父项已同步补录"
IDENTITY_DETAIL = "增加值(11631)与四项费用(11367~11370)之和不符"
ZERO_WATCH_DETAIL = "未调整或调整后仍为0"
WHITELIST_MARK = "白名单"
UNKNOWN_REGION = "未知区域"
LOG_UPDATED = "[数据更新]"
LOG_IMPORTED = "[数据导入]"
LOG_SKIPPED = "[跳过] 文件名无法解析地区/月份"

# Default configuration.
DEFAULT_VALUE_COLUMN = "余额"
DEFAULT_TOLERANCE = 0.01
DEFAULT_BASE_REGION = "惠州市"
DEFAULT_REGIONS = [
    ("惠州市", "惠州市", "base", False),
    ("市本部", "市本部", "member", False),
    ("惠东县", "惠东", "member", False),
    ("惠阳区", "惠阳", "member", True),
    ("博罗县", "博罗", "member", True),
    ("龙门县", "龙门", "member", True),
]
DEFAULT_BACKFILL_MAP = [
    ("11367", "512", 7),
    ("11368", "513", 7),
    ("11369", "514", 7),
    ("11370", "515", 7),
    ("11631", "502", 8),
]
DEFAULT_BACKFILL_PARENTS = ["11364", "11001", "11628", "11371"]
DEFAULT_BACKFILL_REGIONS = ["惠州市"]
DEFAULT_FEE_CODES = ["11367", "11368", "11369", "11370"]
DEFAULT_INCREMENT_CODE = "11631"
DEFAULT_GROUP_A_PARENTS = ["11364", "11001"]
DEFAULT_SOURCE_NO_DATA_REGIONS = ["惠阳区", "博罗县", "龙门县"]
YES_TOKENS = ["是", "1", "y", "Y"]
NO_TOKENS = ["n", "否", "0", "false", "no"]
DEFAULT_FEE_COLUMN = 7

# Rule-driven reshape.
PATH_COLUMNS = ["工作簿名", "工作表名", "数据日期", "行头路径"]
DEFAULT_DEDUP = ["数据日期", "行头路径"]
UNNAMED_COLUMN_PREFIX = "列_"
CODE_COLUMN_WORDS = ["行头路径", "科目代码", "指标代码"]

# Page text.
TITLE_STOP_WORDS = [
    "科目代码", "科目名称", "上期余额", "本期发生额", "本期余额", "借方", "贷方",
    "合计", "编制日期", "编制单位", "制表", "审核", "复核", "共", "第", "页", "单位",
]
MID_HEADER_WORDS = ["科目代码", "科目名称"]
TOTAL_WORD = "合计"
SQUEEZE_WORD = "（国库）"
EXPORT_STEM_PREFIX = "识别结果_"
EXCEL_NAME_LIMIT = 31

# Notes on the choice of a template page.
LOW_SCORE = "结构区命中率仅 "
FORCED_PAGE = "（按指定页填充，请重点核对）"
