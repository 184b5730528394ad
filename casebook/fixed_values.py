"""Texts, limits and tables that results must reproduce exactly."""

# ---- chunking ------------------------------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200

# ---- retrieval -----------------------------------------------------------
FETCH_K = 20
FINAL_K = 5
DIVERSITY_LAMBDA = 0.5
CONTEXT_HEADER = "--- Tài liệu "
CONTEXT_HEADER_END = " ---\n"
CONTEXT_TAIL = "\n\n"
NO_CONTEXT_MESSAGE = (
    "Không tìm thấy thông tin tài chính nào liên quan đến câu hỏi trong cơ sở dữ liệu."
)

# ---- conversation --------------------------------------------------------
NO_ANSWER_MESSAGE = "No response generated"
RETRIEVAL_TOOL = "rag_retrieval"

# ---- request defaults ----------------------------------------------------
DEFAULT_CHARACTER = "normal"
DEFAULT_TONE = 50
DEFAULT_ILLUSTRATION = "none"
ACCEPT_STATUS = 200
REJECT_STATUS = 400
REJECT_CODE = "BAD_REQUEST"
REJECT_DETAILS = "The 'question' field is required"

# ---- tone ----------------------------------------------------------------
TONE_LOW = 30
TONE_MIDDLE = 50
TONE_HIGH = 70
TONE_PREFIX_PLAIN = (
    "Mình sẽ giải thích theo cách dễ hiểu nhưng vẫn đảm bảo đúng pháp luật nhé:\n\n"
)
TONE_PREFIX_BALANCED = (
    "Tôi sẽ trình bày vấn đề một cách cân bằng giữa chuyên môn pháp lý và sự dễ hiểu:\n\n"
)
TONE_LABEL_CASUAL = "Đời thường"
TONE_LABEL_BALANCED = "Cân bằng"
TONE_LABEL_LEGAL = "Pháp lý"

# ---- illustration captions -----------------------------------------------
CAPTION_COMIC = "📖 Minh họa truyện tranh - Dễ nhớ, dễ chia sẻ!"
CAPTION_POSTER = "📢 Poster tuyên truyền - Nâng cao nhận thức pháp luật!"

# ---- practice sessions ---------------------------------------------------
DEFAULT_TIME_LIMIT_MIN = 10
DEFAULT_OBJECTION_LIMIT = 3
TOTAL_ROUNDS = 4
MAX_PAUSES = 3
PAUSE_SECONDS = 10
CRITICAL_SECONDS = 60
WARNING_SECONDS = 180

# ---- scores --------------------------------------------------------------
TIME_SCORE_BASE = 80
TIME_SCORE_STEP_SECONDS = 10
TIME_SCORE_NONE_LEFT = 50
ARGUMENT_BONUS = 10
ARGUMENT_BONUS_ABOVE = 2
EVIDENCE_BONUS = 15
EVIDENCE_BONUS_ABOVE = 1

# Grades: least total, grade, label; the last one takes the rest.
GRADES = [
    (450, "S", "Xuất sắc!"),
    (400, "A", "Rất tốt!"),
    (350, "B", "Tốt"),
    (300, "C", "Khá"),
    (None, "D", "Cần cải thiện"),
]

# Badges: id, name, icon, description, threshold.
BADGES = [
    ("excellent", "Luật sư xuất sắc", "🥇", "Tổng điểm > 400", 400),
    ("evidence", "Bậc thầy chứng cứ", "📊", "Evidence Use > 90", 90),
    ("persuader", "Nhà hùng biện", "🎤", "Persuasion > 90", 90),
    ("speed", "Tốc độ ánh sáng", "⚡", "Hoàn thành trước thời gian", 0),
    ("accurate", "Chính xác tuyệt đối", "🎯", "Legal Accuracy > 95", 95),
    ("polite", "Lịch thiệp", "🤝", "Etiquette = 100", 100),
    ("first_win", "Chiến thắng đầu tiên", "🏆", "Thắng phiên tòa đầu tiên", 0),
    ("streak_3", "Chuỗi 3 trận", "🔥", "Thắng 3 phiên liên tiếp", 3),
    ("master", "Bậc thầy tranh tụng", "👑", "Hoàn thành 10 phiên", 10),
    ("defender", "Người bảo vệ", "🛡️", "Thắng với vai bào chữa", 0),
    ("prosecutor", "Công tố viên", "⚔️", "Thắng với vai nguyên đơn", 0),
    ("comeback", "Lội ngược dòng", "🌊", "Thắng khi bất lợi về điểm", 0),
]
BADGE_TOTAL_ABOVE = 400
BADGE_EVIDENCE_ABOVE = 90
BADGE_PERSUASION_ABOVE = 90
BADGE_LEGAL_ABOVE = 95
BADGE_ETIQUETTE_EQUALS = 100
BADGE_TIME_ABOVE = 90
STREAK_LENGTH = 3
MASTER_SESSIONS = 10
