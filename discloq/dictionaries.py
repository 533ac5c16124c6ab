"""Word lists and constants of the domain. They are fixed values: results depend on them."""

# fixed values: issuer -> short name
ALIASES = {
    "顺丰控股": "顺丰", "圆通速递": "圆通", "韵达股份": "韵达",
    "申通快递": "申通", "中通快递": "中通", "京东物流": "京东物流",
    "极兔速递": "极兔", "华贸物流": "华贸", "东航物流": "东航",
    "中储股份": "中储", "中谷物流": "中谷", "长久物流": "长久",
    "密尔克卫": "密尔克卫", "传化智联": "传化", "嘉友国际": "嘉友",
    "铁龙物流": "铁龙", "中国外运": "中外运",
}

# fixed values: groups of synonymous indicators
SYNONYMS = [
    ["单票收入", "票均收入", "包裹单价", "每票收入", "单票价格"],
    ["市场份额", "市占率", "市场占有率"],
    ["业务量", "包裹量", "件量", "发件量"],
    ["归母净利润", "归属于上市公司股东的净利润"],
    ["毛利率", "毛利"],
]

# fixed values: words of the domain
DOMAIN_WORDS = [
    "单票收入", "单票成本", "票均收入", "包裹单价", "每票收入", "单票价格",
    "业务量", "件量", "市占率", "市场份额", "市场占有率", "毛利率",
    "净利率", "扣非净利润", "归母净利润", "营业收入", "营业成本", "期间费用",
    "销售费用", "管理费用", "研发费用", "财务费用", "经营活动现金流量净额",
    "资产负债率", "加权平均净资产收益率", "基本每股收益", "稀释每股收益",
    "中转", "分拨中心", "加盟商", "直营", "末端网点", "驿站", "智能柜",
    "时效件", "经济件", "特惠专配", "快运", "冷链", "同城", "即时配送",
    "仓配一体", "航空货运", "全货机", "外包", "自有运力", "干线运输",
    "单公斤成本", "客户集中度", "应收账款周转率", "存货周转率", "总资产周转率",
    "快递服务收入", "供应链及国际业务", "跨境电商", "国际快递", "跨境物流",
    "每股经营现金流", "研发投入", "资本开支", "在建工程", "固定资产",
]

# fixed values: words that are no tokens
STOP_WORDS = (
    "的 了 和 与 及 或 在 是 有 为 对 等 中 上 下 之 其 该 本 我 们 他 这 那 "
    "the a an of to in for and or is are was were be been with by at on "
    "公司 报告 年度 期内 余额 期末 年初 本期 上期 项目 单位 元 万元 千元 "
    "一 二 三 四 五 六 七 八 九 十 不 也 都 会 可 以 将 于 由 从 到 按"
).split()

# fixed values: section titles of reports without numbered sections
SECTION_TITLES = [
    "财务摘要", "财务资料摘要", "公司资料", "公司信息", "释义",
    "主席报告", "首席执行官报告", "管理层讨论与分析", "管理层讨论及分析",
    "业务回顾", "经营回顾", "行业概览", "重大事项", "董事及高级管理人员",
    "董事及主要行政人员", "董事会报告", "企业管治报告", "企业管治",
    "环境、社会及管治", "环境、社会及管治报告", "审阅报告", "独立核数师报告",
    "独立核数师审阅报告", "综合损益表", "综合财务状况表", "综合现金流量表",
    "综合权益变动表", "财务报表附注", "主要会计政策", "其他资料", "财务资料",
]

# fixed values: questions with one of these ask for a number
NUMBER_ASKED = (
    "多少 几 金额 收入 利润 毛利 占比 比重 增长率 增速 同比 环比 规模 总额 亿元 万元 比例 率是 达到 排名 第几 市占"
).split()

# fixed values: retrieval and chunking constants
RRF_K, POOL, COVER_POOL = 60, 200, 60
BM25_K1, BM25_B = 1.5, 0.75
CHUNK_TARGET, CHUNK_OVERLAP, CHUNK_MAX = 700, 100, 1100
