"""Dictionaries, patterns and labels the results depend on."""

from __future__ import annotations

# --- fixed values: platforms and hosts (dictionary order matters) -----------
TICKET_PLATFORMS: dict[str, tuple[str, ...]] = {
    "pia": ("t.pia.jp", "ticket.pia.jp", "w.pia.jp"),
    "eplus": ("eplus.jp",),
    "lawson": ("l-tike.com",),
    "rakuten": ("r-t.jp", "ticket.rakuten.co.jp"),
    "ticketboard": ("ticketboard.jp", "tickebo.jp"),
    "cnplayguide": ("cnplayguide.com",),
    "e-get": ("e-get.jp",),
    "tv-asahi-ticket": ("ticket.tv-asahi.co.jp",),
}
NOISY_HOSTS = (
    "x.com", "twitter.com", "instagram.com", "facebook.com", "line.me",
    "youtube.com", "tiktok.com", "pornhub.com", "xvideos.com", "xnxx.com",
    "wikipedia.org", "music.apple.com", "open.spotify.com", "spotify.com",
    "fandom.com", "kprofiles.com", "bilibili.tv", "bilibili.com", "genius.com",
    "last.fm", "discogs.com", "imdb.com",
)
OFFICIAL_HINTS = ("公式", "official", "オフィシャル", "公演", "ライブ", "ミュージカル")
OFFICIAL_HOSTS = (
    "tohostage.com", "umegei.com", "horipro-stage.jp", "horipro.co.jp",
    "stage.co.jp", "marv.jp", "tbs.co.jp", "parco-play.com",
)
TICKET_LINK_HINTS = (
    "ticket", "チケット", "券", "抽選", "先行", "受付", "申込", "発売", "pia", "eplus",
    "ローソン", "lawson", "l-tike", "rakuten", "ticketboard", "ticket board",
    "cnplayguide", "cnプレイガイド",
)
SCHEDULE_LINK_HINTS = (
    "live", "tour", "schedule", "concert", "event", "公演", "ライブ", "ツアー",
    "スケジュール", "コンサート", "live-information", "liveinfo",
)
DETAIL_LINK_SKIPS = ("/news", "/profile", "/biography")
GENERIC_INFO_HOST = "shiki.jp"
GENERIC_INFO_PATHS = ("/tickets", "/tickets_guide", "/door", "/special/info/warning")
STAGE_SCHEDULE_PATH = "/stage_schedule/"

# --- fixed values: thresholds -----------------------------------------------
MIN_KEYWORD_OVERLAP = 0.45
MIN_PAGE_TEXT = 400
EMPTY_PAGE_MARKERS = (
    "情報はありません", "情報がありません", "ただいま準備中", "準備中です", "coming soon",
)

# --- fixed values: date patterns (Java syntax, Unicode classes) -------------
DATE_TOKEN = (
    r"(?:20\d{2}[./-]\d{1,2}[./-]\d{1,2}|20\d{2}年\s*\d{1,2}月\s*\d{1,2}日"
    r"|\d{1,2}[./-]\d{1,2}|\d{1,2}月\s*\d{1,2}日)"
)
RANGE_MARKS = "〜～~–—"
UNI = "(?Ud)"

# --- fixed values: round labels ---------------------------------------------
ROUND_LABEL_PATTERNS = (
    r"第?\s*([0-9０-９一二三四五六七八九十]+)\s*次\s*(?:抽選)?\s*先行",
    r"([0-9０-９]+)\s*次\s*プレ(?:オーダー|リクエスト)",
    r"(?:オフィシャル|公式|ファンクラブ|FC|ぴあ|e\+|ローソン)?\s*(?:抽選|先行|プレオーダー)",
    r"一般発売",
    r"(?:CN|Rakuten|Ticket\s*Board|楽天|チケットボード|CNプレイガイド)?\s*(?:抽選|先行|プレオーダー|プレリクエスト|先着先行)",
    r"先行先着販売",
    r"一般発売",
)
ROUND_EXTRA_PATTERNS = ("受付期間", "申込期間", "抽選結果", "当落", "一般発売")
ROUND_FORWARD_LABELS = ("先行先着販売", "先着先行")
ROUND_CONTEXT_HINTS = (
    "受付期間", "申込期間", "申込み期間", "申込受付期間", "抽選申込期間", "抽選受付期間",
    "当落", "当選発表", "抽選結果", "結果発表", "入金", "支払", "支払い", "支払期限",
    "入金締切", "一般発売", "発売日", "発売開始",
)
ROUND_NUMBERED = r"第\s*[0-9０-９一二三四五六七八九十]+\s*次\s*(?:抽選)?\s*先行"
ROUND_NAME_LABELS = (
    "追加公演・抽選先行", "追加公演・先着先行", "追加公演・一般発売", "追加公演・一般前売",
    "座席選択先行受付", "座席選択先行", "先行抽選エントリー", "先行抽選", "抽選先行",
    "先行先着販売", "先着先行受付", "先着先行", "先行先着", "会員先行予約",
    "四季の会会員先行", "オフィシャル先行", "オフィシャル抽選", "ファンクラブ先行",
    "プレリザーブ", "プレオーダー", "先行予約", "先行受付", "一般前売", "一般発売",
)
APPLICATION_SIGNALS = (
    "受付期間", "申込期間", "申込受付", "エントリー", "受付開始", "お申し込み", "申込開始",
)
SALE_SIGNALS = ("発売日", "一般発売", "一般前売", "発売開始", "販売開始")
ADVANCE_RANGE_LABELS = (
    "受付期間", "申込期間", "申込み期間", "申込受付期間", "抽選申込期間", "抽選受付期間",
    "抽選先行", "先行抽選エントリー", "先着先行", "先行先着販売", "ゴールド会員", "レギュラー会員",
)
PAYMENT_RANGE_LABELS = ("入金期間", "支払期間", "支払い期間", "払込期間", "決済期間")
TRADE_RANGE_LABELS = ("リセール期間", "トレード期間", "公式トレード期間", "チケットトレード期間")
RESULT_LABELS = ("抽選結果", "結果発表", "当落", "当選発表")
MEMBERSHIP_RANGE_LABELS = (
    "ゴールド会員", "レギュラー会員", "シルバー会員", "プレミアム会員", "FC会員",
    "ファンクラブ会員", "有料会員", "無料会員", "非会員", "会員登録なし", "会員登録不要",
)
KANJI_DIGITS = "一二三四五六七八九十"
FULL_WIDTH_DIGITS = "０１２３４５６７８９"

# --- fixed values: event dates and venues -----------------------------------
EVENT_DATE_LABELS = ("公演日", "公演期間", "開催日", "開催日時")
EVENT_DATE_NOISE = ("一般前売", "発売", "先行", "抽選", "料金", "消費税込", "備考", "小人", "追記")
PERIOD_LEAD_NOISE = ("受付", "申込", "抽選", "先行", "販売", "入金", "支払", "発売")
PERIOD_CUT_LABELS = ("受付", "申込", "抽選", "先行", "発売", "販売", "入金", "支払", "エントリー")
PERIOD_START = r"20\d{2}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日(?:\s*[(（][^)）]{1,5}[)）])?"
PERIOD_END = r"(?:20\d{2}\s*年\s*)?(?:\d{1,2}\s*月\s*)?\d{1,2}\s*日(?:\s*[(（][^)）]{1,5}[)）])?"
PERIOD_PATTERN = r"期\s*間\s*(" + PERIOD_START + r"(?:\s*[～~〜\-]\s*" + PERIOD_END + r")?)"
SLASH_PERIOD_PATTERN = (
    r"(20\d{2}/\d{1,2}/\d{1,2}\s*[～~〜\-]\s*20\d{2}/\d{1,2}/\d{1,2})\s*公演"
)
EVIDENCE_DATE = (
    r"(?:20\d{2}年\s*\d{1,2}月\s*\d{1,2}日|20\d{2}[./-]\d{1,2}[./-]\d{1,2}|\d{1,2}月\s*\d{1,2}日)"
    r"(?:\s*[(（][^()（）]{1,5}[)）])?"
)
EVIDENCE_RANGE = (
    EVIDENCE_DATE + r"(?:[^0-9]{0,14})?[〜～~–—](?:[^0-9]{0,14})?" + EVIDENCE_DATE
)
LISTING_PREFECTURE = r"[（(]\s*(?:北海道|東京都|大阪府|京都府|.{2,3}県)\s*[）)]"
LISTING_VENUE = (
    r"(?:劇場|ホール|アリーナ|ドーム|会館|スタジアム|シアター|THEATER|ARENA|HALL|ＴＨＥＡＴＥＲ|ＡＲＥＮＡ|ＨＡＬＬ)"
)
APPLICATION_WINDOW_SIGNALS = (
    "受付期間", "申込期間", "申込み期間", "申込受付期間", "抽選申込期間", "抽選受付期間",
    "エントリー期間", "受付開始", "申込開始",
)
VENUE_BOUNDARY = (
    r"(?=〒|MAP|座席表|【|チケット|抽選|先行|受付|申込|発売|公演日|出演|料金|開場|開演|主催"
    r"|お問い?合せ|お問い合わせ|TEL|$)"
)
VENUE_PATTERNS = (
    r"会\s*場のご案内\s*([^。【\n\r]{2,80}?)" + VENUE_BOUNDARY,
    r"会\s*場\s*([^。【\n\r]{2,80}?)" + VENUE_BOUNDARY,
    r"(?:東京|大阪|名古屋|京都|福岡|札幌|仙台|静岡|広島|全国)\s+([^\s。]{2,40}(?:劇場|ホール|アリーナ|ドーム|会館)(?:［[^］]+］)?(?:（[^）]+）)?)",
    r"([\w一-龥ぁ-んァ-ヶー・（）() ]{2,40}(?:劇場|ホール|アリーナ|ドーム|会館|大劇場|小劇場))",
)
VENUE_CONTEXT_NOISE = ("交通アクセス", "駐車場", "公演スケジュール情報はありません")
VENUE_NOISE = (
    "チケット", "ご購入", "ご予約", "販売", "受付", "お問い合わせ", "お問合せ", "主催", "電話",
    "ぜひ", "グループ観劇", "座席料金", "座席図", "アクセス", "車いす", "現在", "スケジュール情報",
    "公演一覧", "Facebook", "LINE",
)
PREFECTURES = (
    "北海道", "青森", "岩手", "宮城", "秋田", "山形", "福島", "茨城", "栃木", "群馬",
    "埼玉", "千葉", "東京", "神奈川", "新潟", "富山", "石川", "福井", "山梨", "長野",
    "岐阜", "静岡", "愛知", "三重", "滋賀", "京都", "大阪", "兵庫", "奈良", "和歌山",
    "鳥取", "島根", "岡山", "広島", "山口", "徳島", "香川", "愛媛", "高知", "福岡",
    "佐賀", "長崎", "熊本", "大分", "宮崎", "鹿児島", "沖縄",
)
VENUE_SUFFIXES = (
    "アリーナ", "ホール", "ドーム", "スタジアム", "スタジオ", "劇場", "会館", "公会堂",
    "体育館", "メッセ", "フォーラム", "ガーデン", "センター", "Zepp", "国際展示場",
    "サンプラザ", "ベイホール", "プラザ", "ピット", "ラウンジ",
)
TITLE_PLACE = r"\b(?:AT|IN)\s+([A-Z][A-Za-z'’.]+(?:\s+(?:&\s+)?[A-Z][A-Za-z'’.]+){0,3})"
LOCATION_REGIONS = (
    "東京", "大阪", "名古屋", "京都", "福岡", "札幌", "仙台", "静岡", "広島", "群馬", "神奈川",
    "埼玉", "千葉", "兵庫", "愛知", "北海道", "全国",
)
TOUR_CITIES = (
    "東京", "大阪", "名古屋", "福岡", "札幌", "仙台", "横浜", "京都", "神戸", "広島",
    "金沢", "静岡", "北海道", "愛知", "兵庫", "群馬", "埼玉", "千葉", "神奈川", "新潟",
)
VENUE_CITIES = (
    ("御園座", "名古屋"), ("梅田", "大阪"), ("有明", "東京"), ("EXシアター", "東京"),
    ("日生劇場", "東京"), ("帝国劇場", "東京"), ("博多座", "福岡"), ("南座", "京都"),
    ("シアターBRAVA", "大阪"), ("オリックス", "大阪"), ("キャナルシティ", "福岡"),
)
ALL_PERFORMANCES = "公演共通 (all performances)"
ADDED_SHOW = "追加公演"
SUMMARY_LABELS = ("公演概要", "ストーリー", "あらすじ")

# --- fixed values: notes, rules, prices -------------------------------------
RULE_HINTS = ("未就学", "入場", "有償譲渡", "転売", "車椅子", "身分証", "本人確認", "禁止", "注意", "同意")
RULE_BARE = ("同意", "注意", "禁止", "入場")
RULE_SKIPS = ("重要なお知らせ", "＞＞", ">>", "クッキー")
RULE_CONTINUATIONS = ("なお、", "なお ")
PRICE_TIER = r"(?:チケット\s*)?(S席|A席|Yシート(?:（[^）]+）)?|U-25(?:（[^）]+）)?)[：:]"
PRICE_STOP = r"(?=＊＝|※|チケット販売|Tickets|News|Tour|Cast)"
PRICE_LOOSE = r"(?:チケット\s*)?(?:S席|A席|Yシート|U-25)[^。※\n\r]{0,260}?\d[\d,]*\s*円[^。※\n\r]{0,260}"
PRICE_YEN = r"\d[\d,]*\s*円"
PRICE_LEAD = r"^.*?(?=(?:チケット|料金|S席|A席|Yシート|U-25))"

# --- fixed values: statuses, labels, preferences ----------------------------
STATUS_RANK = {
    "closing_soon": 0, "results_today": 1, "payment_due": 2, "general_sale_soon": 3,
    "open": 4, "upcoming": 5, "unknown": 6, "closed": 7,
}
STATUS_LABELS = {
    "closing_soon": "Closing soon", "results_today": "Results today",
    "payment_due": "Payment due", "general_sale_soon": "General sale soon",
    "open": "Open now", "upcoming": "Upcoming", "closed": "Closed",
}
ROUND_TYPE_LABELS = {
    "fc": "Fan club", "general": "General sale", "trade": "Resale",
    "official": "Official", "platform": "Platform presale",
}
MEMBERSHIP_LABELS = {"yes": "Membership required", "no": "No membership needed"}
ALERT_TYPES = (
    "new_official_page", "new_ticket_link", "new_lottery_round", "ticket_field_changed",
    "lottery_opened", "lottery_closing_soon", "results_today", "payment_due_soon",
    "general_sale_soon", "watch_failed",
)
REMINDER_FIELDS = (
    ("application_start_at", "Lottery application opens"),
    ("application_end_at", "Lottery application closes"),
    ("results_date", "Lottery results announced"),
    ("payment_end_at", "Payment deadline"),
    ("general_sale_date", "General sale"),
)
SCOPES = ("artist_all", "event_all", "event_location", "round")

# --- fixed values: words that tell a round's type and membership, and snippet patterns ---
FAN_CLUB_WORDS = ("fc", "ファンクラブ")
GENERAL_WORDS = ("一般発売",)
TRADE_WORDS = ("トレード", "リセール")
OFFICIAL_WORDS = ("公式", "オフィシャル")
PLATFORM_WORDS = ("pia", "ぴあ", "e+", "ローソン", "lawson")
ADVANCE_WORDS = ("抽選", "先行", "プレオーダー")
MEMBER_WORDS = ("fc", "ファンクラブ", "会員")
SNIPPET_NOTICE = r"※【重要なお知らせ】[^＞>]*(?:＞＞|>>)?"
SNIPPET_LABEL = r"【[^】]*(?:抽選|先行|一般発売|発売|受付)[^】]*】"
