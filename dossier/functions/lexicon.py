"""Word lists and weights of question understanding and ranking. All are fixed values that results depend on."""

# Terms of question intents.
TABLE_TERMS = ("table", "tabular", "表", "表格", "表题")
FIGURE_TERMS = ("fig.", "figure", "chart", "plot", "image", "diagram", "curve", "图", "圖", "图片", "图像", "图表", "图文", "曲线", "趋势")
CROSS_MODAL_TERMS = ("cross-modal", "multimodal", "跨模态", "多模态", "结合")
LOCATION_TERMS = ("bbox", "bounding-box", "grounding", "定位", "证据定位", "页")
TEXT_FACT_TERMS = ("文本事实",)
VISUAL_TYPE_TERMS = ("表格问答", "图文一致性", "图表理解", "跨模态综合")

# Structured-table and multi-hop reasoning.
STRUCTURED_TYPE_TERMS = ("text_table_rag", "table_qa", "tat_qa", "tat-qa", "finqa", "financial_table", "structured_table")
STRUCTURED_QUERY_TERMS = ("percentage", "percent", "growth", "change", "fiscal", "annual", "10-k", "income", "revenue", "sales", "debt", "liabilities", "assets", "cash flow", "net sales", "operating profit", "gross margin", "inventory", "obligations", "million", "billion")
TABLEISH_TERMS = ("table", "tabular", "as reported", "financial report")
MULTIHOP_TYPE_TERMS = ("comparison_query", "inference_query", "temporal_query", "null_query", "multi_hop", "multihop", "multi-hop")
MULTIHOP_QUERY_TERMS = ("compare", "comparison", "both", "shared", "common", "between", "relationship", "difference", "earlier", "later", "before", "after", "temporal", "infer", "inference", "比较", "关系", "共同", "之间", "推断", "先后")

# After-sales intents, in the order in which ties are decided.
AFTER_SALES_TERMS = {
    "return_refund": ("7天", "七天", "无理由", "退货", "换货", "退换", "退款", "运费", "return", "refund", "exchange"),
    "invoice": ("发票", "开票", "抬头", "税号", "invoice"),
    "shipping_damage": ("物流", "快递", "运输", "包装破损", "破损", "签收", "包裹", "shipping", "package"),
    "warranty_repair": ("售后", "保修", "维修", "送修", "人为损坏", "质保", "客服", "warranty", "repair", "service"),
    "troubleshooting": ("故障", "异常", "无法", "不能", "不工作", "没反应", "报错", "重启", "漏水", "噪音", "充电", "开机", "troubleshoot", "error", "fault"),
    "usage_operation": ("如何", "怎么", "步骤", "安装", "设置", "清洁", "使用", "连接", "校准", "operation", "setup"),
    "spec_parts": ("规格", "参数", "尺寸", "电压", "容量", "配件", "清单", "型号", "spec", "parts"),
    "safety": ("安全", "警告", "注意", "危险", "儿童", "火灾", "触电", "烫伤", "safety", "warning"),
}
AFTER_SALES_HINTS = ("售后", "客服", "保修", "维修", "手册", "说明书", "manual", "after-sales", "customer service", "manual_customer_service", "manual_qa")

# Product groups and their aliases.
PRODUCT_ALIASES = {
    "空调": ("空调", "air conditioner", "air conditioning", "ac"),
    "电钻": ("电钻", "drill", "electric drill"),
    "空气净化器": ("空气净化器", "air purifier"),
    "吹风机": ("吹风机", "hair dryer", "blow dryer"),
    "洗碗机": ("洗碗机", "dishwasher", "dish washer"),
    "健身单车": ("健身单车", "exercise bike", "fitness bike", "stationary bike"),
    "蒸汽清洁机": ("蒸汽清洁机", "steam cleaner", "steam mop"),
    "儿童电动摩托车": ("儿童电动摩托车", "kids electric motorcycle", "electric motorcycle", "toy motorcycle"),
    "冰箱": ("冰箱", "refrigerator", "fridge"),
    "摩托艇": ("摩托艇", "jetski", "jet ski", "watercraft"),
    "人体工学椅": ("人体工学椅", "ergonomic chair", "office chair"),
    "功能键盘": ("功能键盘", "function keyboard", "keyboard"),
    "烤箱": ("烤箱", "oven"),
    "相机": ("相机", "camera"),
    "可编程温控器": ("可编程温控器", "programmable thermostat", "thermostat"),
    "健身追踪器": ("健身追踪器", "fitness tracker", "activity tracker"),
    "水泵": ("水泵", "water pump", "pump"),
    "发电机": ("发电机", "generator"),
    "VR头显": ("VR头显", "vr headset", "virtual reality headset"),
    "蓝牙激光鼠标": ("蓝牙激光鼠标", "bluetooth laser mouse", "laser mouse", "mouse"),
    "耳机": ("earphones", "earbuds", "headphones", "耳机"),
    "电子书阅读器": ("ereader", "e-reader", "ebook reader", "电子书", "阅读器"),
    "传真机": ("fax", "fax machine", "传真"),
    "烤架": ("grill", "barbecue", "bbq"),
    "座机": ("landline", "handset", "base station", "telephone"),
    "割草机": ("lawn mower", "mower"),
    "微波炉": ("over-the-range microwave", "microwave"),
    "主板": ("motherboard", "bios", "sata", "pci express", "cpu"),
    "压力锅空气炸锅": ("multi-use pressure cooker", "pressure cooker", "air fryer"),
    "扫地机/吸尘器": ("vacuum cleaner", "vacuum", "home base"),
    "雪地摩托": ("snowmobile",),
    "电视/收音": ("television", "tv", "radio", "dvd player", "outdoor antenna"),
    "电动牙刷": ("electric toothbrush", "toothbrush"),
    "coffee_machine": ("coffee machine", "coffee maker", "nespresso", "espresso", "lungo"),
    "boat": ("boat", "anchor light", "sail", "stern light", "navigation light"),
    "loudspeaker": ("loudspeaker", "speaker", "wireless speaker"),
    "gps_navigation": ("gps", "navigator", "navigation", "nav", "route guidance"),
    "robot_vacuum": ("vacuum", "robot vacuum", "roomba", "home base", "full bin sensor", "charging contacts"),
}

# Node id prefixes, edge and node weights.
NODE_PREFIX = {"text": "T", "table": "TB", "figure": "F", "page": "P", "caption": "C", "title": "H", "equation": "E"}
EDGE_WEIGHTS = {"parent_section": 0.45, "chunk_sequence": 0.08, "belongs_to_page": 0.05, "same_page": 0.03, "figure_caption": 1.2, "table_caption": 1.2, "section_title": 0.35, "same_section": 0.12, "text_ref_table": 1.0, "text_ref_figure": 1.0, "section_multimodal_peer": 0.18, "same_context_text": 0.2, "same_context_table": 0.62, "same_context_figure": 0.62, "same_context_visual": 0.48}
RELATION_WEIGHTS = {"same_page": 0.05, "belongs_to_page": 0.05, "same_context_visual": 0.62, "same_context_table": 0.72, "same_context_figure": 0.72, "same_context_text": 0.28, "section_multimodal_peer": 0.24, "text_ref_table": 1.0, "text_ref_figure": 1.0, "table_caption": 1.2, "figure_caption": 1.2, "section_title": 0.35, "same_section": 0.12, "parent_section": 0.45, "chunk_sequence": 0.08, "related": 0.2}
TYPE_WEIGHTS = {"text": 1.0, "caption": 0.8, "table": 0.5, "figure": 0.5, "page": 0.1}
VISUAL_TYPES = ("table", "figure", "caption")

# Words that support no answer.
ANSWER_STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "you", "your", "根据", "证据", "当前", "可以", "需要", "显示", "说明", "问题")

# Knowledge graph of after-sales service.
KG_CONCRETE = ("product", "part", "fault", "image")
KG_POLICIES = {"return_refund": "退换货退款", "invoice": "发票开票", "shipping_damage": "物流包装破损", "warranty_repair": "保修维修", "troubleshooting": "故障排查", "usage_operation": "安装使用", "spec_parts": "规格配件", "safety": "安全警告"}
KG_GENERIC_POLICY = ("售后", "客服", "商品", "服务", "支持", "范围", "如何", "怎么", "需要", "after-sales", "customer service", "service", "support")
KG_GENERIC_ACTION = ("use", "operate", "使用", "操作")

# Hints that expand a question by its route, product, type and service terms.
ROUTE_HINTS = {
    "service": "after-sales policy customer service proof order number receipt warranty return refund exchange shipping invoice complaint",
    "service_with_product": "product manual troubleshooting operation parts installation safety specification diagram",
    "manual": "manual instructions operation setup maintenance safety warning specification parts",
    "manual_visual": "manual diagram figure picture button indicator part location table step visual evidence",
    "visual": "figure diagram table image caption OCR label part position visual evidence",
}
PRODUCT_HINTS = {
    "air_conditioner": "air conditioner AC indoor unit filter grille air inlet outlet operation lamp remote control clean safety",
    "air_purifier": "air purifier filter plastic packaging top cover clean replacement indicator safety",
    "camera": "camera shutter button battery CF card lens sensor power switch authorized repair disassembly",
    "coffee_machine": "coffee machine espresso lungo Nespresso energy saving mode factory reset water volume descaling cleaning",
    "boat": "boat anchor light bimini top livewell swim platform engine steering cooling system fuse throttle cable",
    "dishwasher": "dishwasher installation water supply drain electrical connection detergent salt child safety",
    "drill": "electric drill battery indicator charging overheat overcool delay bit torque speed",
    "earphones": "earphones earbuds headphones pairing bluetooth charging indicator reset audio",
    "ereader": "eReader ebook reader micro SD card reset screen battery charging troubleshooting",
    "exercise_bike": "exercise bike fitness bike assembly seat pedal resistance console heart rate belt",
    "fax": "fax fax machine product safety guide power cord warning maintenance telephone line",
    "fitness_tracker": "fitness tracker activity tracker strap band charging cable package contents size wrist",
    "generator": "generator engine fuel oil spark plug choke starter switch overload safety maintenance",
    "grill": "grill barbecue burner gas propane ignition cleaning safety cooking grate",
    "hair_dryer": "hair dryer blow dryer cool shot heat airflow filter nozzle cleaning indicator",
    "jetski": "jetski jet ski watercraft engine start lanyard safety warning riding practice boarding throttle",
    "keyboard": "keyboard function keyboard key switch warranty cable backlight cleaning",
    "landline": "landline telephone handset base station cordless phone battery voicemail caller ID",
    "loudspeaker": "loudspeaker speaker pairing Bluetooth buttons volume charging indicator",
    "lawn_mower": "lawn mower blade start handle safety oil grass bag maintenance",
    "microwave": "microwave oven turntable installation vent filter control panel safety",
    "motherboard": "motherboard BIOS SATA ODD USB OS installation DDR4 DIMM CPU memory socket driver",
    "mouse": "bluetooth laser mouse pairing battery button DPI receiver reset",
    "oven": "oven installation cabinet electrical connection heat resistant door damage authorized service",
    "pressure_cooker": "pressure cooker air fryer lid valve pressure release basket cooking safety clean",
    "refrigerator": "refrigerator fridge freezer temperature door seal water filter defrost safety",
    "gps_navigation": "GPS navigator navigation NAV route guidance screen reset pairing",
    "robot_vacuum": "robot vacuum Roomba Home Base CLEAN button full bin sensors charging contacts troubleshooting indicator",
    "snowmobile": "snowmobile engine start throttle brake safety warning maintenance track",
    "steam_cleaner": "steam cleaner steam mop water tank nozzle brush descaling safety",
    "toothbrush": "electric toothbrush brush head charging mode timer safety cleaning",
    "tv_radio": "television TV radio DVD antenna caption channel power cord safety",
    "vacuum": "vacuum cleaner robot vacuum home base filter bin sensor charging contacts clean",
    "vr_headset": "VR headset processor unit HDMI USB AUX DC IN status indicator ventilation cable",
    "water_pump": "water pump engine fuel switch priming plug drain plug throttle handle inlet outlet hose filter",
}
TYPE_HINTS = {
    "退换货": "return refund exchange eligibility proof shipping fee RMA",
    "退款": "return refund exchange eligibility proof shipping fee RMA",
    "发票": "invoice receipt title tax number issue correction delivery time",
    "物流": "shipping delivery pickup tracking receipt freight rural area",
    "保修": "warranty repair fault responsibility proof RMA service scope",
    "维修": "warranty repair fault responsibility proof RMA service scope",
    "安装": "installation setup authorized service parts fee damage proof",
    "故障": "troubleshooting fault error indicator reset repair safety",
    "部件": "parts component diagram label position interface connector",
    "安全": "safety warning caution danger personal injury electric shock",
}
SERVICE_HINTS = {
    "售后": "after-sales customer service handling procedure responsibility proof",
    "换货": "exchange eligibility proof RMA return shipping",
    "退款": "refund return eligibility proof processing",
    "退货": "return refund eligibility proof shipping",
    "运费": "shipping fee freight return postage responsibility",
    "发票": "invoice receipt title tax number issue time",
    "保修": "warranty repair proof service period fault",
    "维修": "repair warranty fault responsibility service center",
    "物流": "shipping delivery pickup tracking receipt",
    "投诉": "complaint evidence photos order number escalation",
}
