"""Word lists of the market text jobs.  All lists here are fixed values."""

# Slang term, meaning, sentiment modifier, in order.
SLANG = (
    ("lùa gà", "pump and dump scam", -0.3),
    ("cá mập", "whale/big investor", 0.0),
    ("gom hàng", "accumulating shares", 0.2),
    ("xả hàng", "dumping shares", -0.2),
    ("tay to", "major player", 0.0),
    ("đánh úp", "surprise dump", -0.3),
    ("bắt đáy", "catching the bottom", 0.1),
    ("cắt lỗ", "stop loss", -0.1),
    ("chốt lời", "take profit", 0.1),
    ("trần", "ceiling price", 0.2),
    ("sàn", "floor price", -0.2),
    ("xanh", "green/up", 0.1),
    ("đỏ", "red/down", -0.1),
    ("tím", "purple/limit up", 0.3),
    ("xanh lơ", "ceiling limit", 0.2),
    ("la liệt", "widespread red", -0.2),
    ("bơm thổi", "pump artificially", -0.2),
    ("mua đuổi", "chasing buy", 0.1),
    ("bán tháo", "panic sell", -0.3),
    ("đội lái", "market manipulator team", -0.2),
    ("giải chấp", "margin call", -0.3),
    ("cây thông", "bullish pattern", 0.2),
    ("con tép", "small investor", 0.0),
    ("hốt", "buy opportunity", 0.2),
    ("sideway", "sideways trend", 0.0),
    ("fomo", "fear of missing out", -0.1),
    ("về bờ", "break even", 0.1),
    ("lên tàu", "get in position", 0.1),
    ("xuống tàu", "exit position", -0.1),
)

# Positive and negative keywords, in order.
POSITIVE = (
    "tăng", "lợi nhuận", "kỷ lục", "đột phá", "thắng lớn", "doanh thu tăng", "tích cực", "triển vọng tốt", "mua mạnh", "vượt kỳ vọng", "tăng trưởng",
    "cổ tức cao", "lạc quan", "khuyến nghị mua", "tiềm năng", "hấp dẫn", "cơ hội", "phục hồi", "bứt phá", "thu hút", "dòng tiền mạnh",
)
NEGATIVE = (
    "giảm", "thua lỗ", "sụt giảm", "bán tháo", "sập sàn", "nợ xấu", "phá sản", "cảnh báo", "điều tra", "gian lận", "thao túng", "vi phạm",
    "đình chỉ", "rủi ro", "thận trọng", "suy yếu", "áp lực", "bất ổn", "khó khăn", "tiêu cực", "hủy niêm yết", "kiện tụng", "thanh tra",
)

# Keywords of the rule-based sentiment, in order.
RULE_POSITIVE = (
    "tăng", "tang", "tích cực", "tich cuc", "khả quan", "kha quan", "bullish", "buy", "mua", "lợi nhuận", "loi nhuan", "tăng trưởng",
    "breakout", "buy_opportunity", "bullish_pattern", "take_profit",
)
RULE_NEGATIVE = (
    "giảm", "giam", "tiêu cực", "tieu cuc", "rủi ro", "rui ro", "bearish", "sell", "bán", "lỗ", "lo", "sụt giảm",
    "pump_and_dump", "price_manipulation", "bearish_pattern", "stop_loss",
)

# Slang to token, in order of replacement.
SLANG_TOKENS = (
    ("cây thông", "bullish_pattern"), ("cay thong", "bullish_pattern"), ("cây súng", "bearish_pattern"), ("cay sung", "bearish_pattern"),
    ("múa bên trăng", "price_manipulation"), ("mua ben trang", "price_manipulation"), ("lùa gà", "pump_and_dump"), ("lua ga", "pump_and_dump"),
    ("bơm", "pump_scheme"), ("xả", "dump_scheme"), ("con tép", "retail_investor"), ("con tep", "retail_investor"),
    ("cá mập", "institutional_investor"), ("ca map", "institutional_investor"), ("chốt lời", "take_profit"), ("chot loi", "take_profit"),
    ("cắt lỗ", "stop_loss"), ("cat lo", "stop_loss"), ("bắt đáy", "bottom_fishing"), ("bat day", "bottom_fishing"),
    ("bắt dao rơi", "catching_falling_knife"), ("fomo", "fear_of_missing_out"), ("all in", "invest_all_capital"), ("ôm", "hold_long_term"),
    ("hốt", "buy_opportunity"), ("hot", "buy_opportunity"), ("sideway", "sideways_trend"), ("breakout", "price_breakout"),
    ("tạo đáy", "forming_bottom"), ("tao day", "forming_bottom"), ("tạo đỉnh", "forming_top"), ("tao dinh", "forming_top"),
    ("thanh khoản", "liquidity"), ("thanh khoan", "liquidity"), ("vốn hóa", "market_cap"), ("von hoa", "market_cap"),
    ("room ngoại", "foreign_ownership_room"), ("room ngoai", "foreign_ownership_room"), ("margin call", "margin_call"), ("t+", "settlement_period"),
)

# Spam keywords of feeds.
SPAM_KEYWORDS = (
    "khuyến mại", "đăng ký ngay", "cơ hội vàng", "click ngay", "nhận quà", "giảm giá sốc", "miễn phí 100%", "lùa gà", "pump", "group vip",
    "room kín", "đánh lên", "chắc thắng", "x2 x3", "theo dõi kênh", "subscribe", "like share",
    "khuyến mãi", "khuyen mai", "dang ky ngay", "nhóm vip", "nhom vip", "bảo lãi", "bao lai", "cam kết lời", "cam ket loi",
    "liên hệ zalo", "lien he zalo", "inbox nhận", "inbox nhan", "free signal", "tín hiệu miễn phí",
)

# Spam patterns, case-insensitive.
SPAM_PATTERNS = (r"lợi nhuận \d+%", r"tăng \d+x trong", r"nhóm (vip|kín|riêng)", r"zalo:?\s*\d{10,11}")

# Listed symbols.
VALID_SYMBOLS = (
    "VNM", "HPG", "VCB", "VHM", "VIC", "FPT", "MSN", "MBB", "TCB", "BID", "CTG", "GAS", "SAB", "VRE", "PLX", "VPB", "NVL", "MWG", "POW", "STB",
    "ACB", "HDB", "TPB", "VJC", "VND", "SSI", "HCM", "BCM", "PDR", "DIG", "KDH", "DGC", "GEX", "REE", "VCI", "DPM", "DCM", "PVD", "PVS", "GMD",
)

# The seed rows of the security master.
STOCKS = (
    ("VNM", "Công ty CP Sữa Việt Nam", "HSX", "Thực phẩm"),
    ("FPT", "Công ty CP FPT", "HSX", "Công nghệ"),
    ("VIC", "Tập đoàn Vingroup", "HSX", "Bất động sản"),
    ("HPG", "Tập đoàn Hòa Phát", "HSX", "Thép"),
    ("VHM", "Vinhomes", "HSX", "Bất động sản"),
    ("VCB", "Vietcombank", "HSX", "Ngân hàng"),
    ("BID", "BIDV", "HSX", "Ngân hàng"),
    ("TCB", "Techcombank", "HSX", "Ngân hàng"),
    ("MBB", "MB Bank", "HSX", "Ngân hàng"),
    ("VPB", "VPBank", "HSX", "Ngân hàng"),
    ("MWG", "Thế Giới Di Động", "HSX", "Bán lẻ"),
    ("VNR", "Tổng Công ty Cổ phần Tái bảo hiểm Quốc gia", "HSX", "Bảo hiểm"),
    ("SSI", "SSI Securities", "HSX", "Chứng khoán"),
    ("VND", "VNDirect Securities", "HSX", "Chứng khoán"),
    ("PNJ", "Phú Nhuận Jewelry", "HSX", "Bán lẻ"),
)
