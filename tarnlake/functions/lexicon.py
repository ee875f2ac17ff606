"""Word lists, patterns and fixed enumerations. Each is a default that callers may replace."""

# They decide results, and are kept as given.

#: Weight of an opinion by channel; other channels weigh 1.0.
CHANNEL_WEIGHTS = {"youtube": 1.0, "community": 0.9, "blog": 0.9}
POLARITY_SIGN = {"positive": 1, "negative": -1, "neutral": 0}

MIN_COMMENT_CHARS = 10
HAS_CONTENT = r"[0-9A-Za-z가-힣]"
PURE_FILLER = r"^[ㅋㅎㅠㅜ;~!?.\s\d]+$"
NOISE_SHORT = (
    r"^(?:좋아요|굿|최고(?:예요|에요|네요)?|대박|짱|와+우?|헐|미쳤다)[!~.\s]*$",
    r"^(?:영상|편집|목소리|썸네일|채널|구독|알림\s?설정|인트로)\S*\s*(?:너무\s*)?(?:잘\s?봤|잘\s?보고|좋|감사|최고|예쁘|멋지)",
    r"^\d+\s*등[!~.\s]*$",
)
EXPLETIVE = r"아?\s*시\s*발|씨\s*발|시\s*바|ㅅㅂ|존나|ㅈㄴ|병신|ㅄ|미친|ㅁㅊ|지랄|ㅈㄹ"
LAUGHTER = r"[ㅋㅎㅜㅠㅗㅡ]"
QUESTION_MAX_CHARS = 100
QUESTION_END = r"나요\s*\??$|인가요\s*\??$|될까요\s*\??$|건가요\s*\??$|하나요\s*\??$|있나요\s*\??$|있을까요\s*\??$|[까]\s*요?\s*\??$|ㄴ가요\s*\??$|\?\s*$"
SENTENCE_SPLIT = r"[.!。\n]+"
LABEL_SPLIT = r"[\s·/()\[\]{}, ~\-]+"

ASPECT_KEYWORDS = {
    "overseas_payment_convenience": ("해외결제", "해외 결제", "결제 안됨", "결제오류", "결제 오류", "해외에서", "애플페이", "구글페이", "삼성페이", "GLN", "gln", "QR결제", "비자", "마스터", "페이", "결제", "overseas"),
    "exchange_rate_fairness": ("환율", "환전 수수료", "수수료", "환전", "달러", "엔화", "유로", "위안", "원화", "외화", "실시간 환율", "우대환율", "환율 우대"),
    "atm_withdrawal_ux": ("ATM", "atm", "현금인출", "현금 인출", "출금", "현금", "인출", "CD기", "자동화기기"),
    "app_ux_quality": ("앱", "어플", "앱이", "앱에서", "인터페이스", "토스", "앱 오류", "앱 버그", "앱 업데이트", "UI", "UX", "알림", "설정", "로그인"),
    "emergency_card_lock": ("잠금", "분실", "카드 정지", "카드잠금", "분실신고", "도난", "카드 해지", "일시정지", "해외 분실"),
    "pricing_perception": ("수수료", "비용", "요금", "이용료", "연회비", "무료", "유료", "과금", "청구", "가격", "요금제"),
    "travel_benefit_value": ("혜택", "마일리지", "마일", "포인트", "라운지", "캐시백", "적립", "할인", "무료 제공", "특전", "여행자 보험", "보험"),
    "customer_support": ("고객센터", "상담", "CS", "문의", "콜센터", "전화", "답변", "응대", "처리"),
    "fx_reload_convenience": ("충전", "환전하기", "재충전", "잔액", "계좌", "이체", "입금", "송금", "환전소"),
}

PROFANITY = (
    "씨발", "시발", "씨바", "시바", "쓰발", "ㅅㅂ", "ㅄ", "병신", "븅신", "존나", "ㅈㄴ", "좆", "지랄", "ㅈㄹ", "개새끼", "개색끼", "새끼", "썅",
    "꺼져", "닥쳐", "엿같", "좆같", "개같", "등신", "머저리", "한심", "fuck", "shit", "bitch", "asshole",
)
SUBSTANCE = (r"\d", r"%|원|개월|년|회|배|분|시간|일|건|장", r"보다|대비|비해|보단|에 ?비하", r"때문|덕분|라서|어서|니까|므로", r"경우|할 ?때|면 |면,|면\.")
SPAM = r"https?://|www\.|카톡|텔레그램|디엠으로|문의는|010[- ]?\d{3,4}"
CONFIRM_REQUEST = r"(아닌가요|아닌가\?|아닌가…|아닌가\.\.|맞나요|맞죠|맞는지요|건가요|아니었음|아니에요\?|아닌거죠)"

PERSPECTIVES = ("cost", "reliability", "convenience", "coverage", "exchange_rate", "benefit", "overall", "other")
QUESTION_TYPES = ("feasibility", "method", "cost", "condition", "comparison", "recommendation", "troubleshooting", "safety_anxiety", "other")
QUESTION_GROUPS = {
    "info": ("feasibility", "condition", "comparison", "method"), "recommendation": ("recommendation",), "cost": ("cost",),
    "troubleshooting": ("troubleshooting",), "other": ("safety_anxiety", "other"),
}
#: Rules of the stand-in question classifier, in order: type, and words of which one must occur.
QUESTION_RULES = (("troubleshooting", ("왜", "안돼", "안되", "문제")), ("cost", ("수수료", "얼마")), ("method", ("어떻게", "방법")), ("feasibility", ("되나", "가능", "되는")))
EXCLUDED_LABELS = ("", "기타_트래블카드", "비트래블카드")
OTHER, OVERALL = "기타", "종합"

PLATFORMS = ("instagram", "x", "youtube_official", "blog_naver", "blog_tistory", "blog_self_hosted", "press_release")
TRACKING_PARAMETER = r"^(?:utm_.*|fbclid|gclid|igshid|ref)$"
LINK_MARK = "[링크]"
#: Captions that stand among landed comments.
COMMENT_CAPTIONS = ("댓글 영역", "댓글")
EMBED_CARD = r"\[링크\]\n(?:[^\n]*\n)*?(?:www\.|m\.|n\.)?[\w-]+(?:\.[\w-]+)*\.(?:com|net|kr|org|io|tv)[ \t]*(?:\n|$)"

SAMPLE_LEVELS = ((20, "ratio"), (10, "direction"), (5, "thin"))
TIE_GAP = 0.10
EVIDENCE_CAP = 60
VERDICTS = {"unmeasured": "측정 불가", "thin": "표본 부족", "unknown": "판단 불가", "equal": "동률", "close": "접전", "ahead": "우위", "behind": "열위"}

ALL_KEYWORDS = tuple(dict.fromkeys(k for words in ASPECT_KEYWORDS.values() for k in words))
