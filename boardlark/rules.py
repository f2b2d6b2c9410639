"""Rule data that decides results.  Everything here is injectable: operators take it as a parameter with these values as the default."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: search stop-words, synonym groups in order (a term belongs to the first group that holds it). ---
STOP_WORDS = frozenset(
    "공지 공지사항 정보 내용 관련 문의 질문 알려줘 알려주세요 보여줘 보여주세요 뭐야 무엇 뭔지 정리 요약 최신 최근 확인 안내 좀 해줘 해주세요"
    " please show find about latest info".split()
)
SYNONYMS = (
    ("기숙사", "생활관"),
    ("공모전", "대회", "경진대회", "공모"),
    ("장학", "장학금", "장학생"),
    ("입시", "입학", "신입생"),
    ("기말고사", "기말시험"),
    ("중간고사", "중간시험"),
    ("시험", "기말시험", "중간시험"),
    ("박람회", "설명회"),
    ("AI융합대", "AI융합대학", "AI융합"),
    ("항공경영대", "항공경영대학", "항공·경영대학"),
    ("공과대", "공과대학"),
    ("휴학", "휴학신청"),
    ("복학", "복학신청"),
    ("채용", "모집", "선발"),
    ("인턴", "인턴십"),
)

# --- Fixed values: facet tokens that mean "empty" and filter tokens that mean "no filter". ---
EMPTY_TOKENS = ("", "-", "_", "n/a", "na", "none", "null", "undefined", "미분류")
ALL_TOKENS = (
    "__all_sources__", "__all_departments__", "__all_categories__", "__all_audiences__", "__all_source_groups__", "all",
    "전체", "전체출처", "전체 출처", "전체홈페이지", "전체 홈페이지", "전체중분류", "전체 중분류", "전체그룹", "전체 그룹", "전체부서", "전체 부서", "전체분류", "전체 분류",
)

# --- Fixed values: field aliases of raw notices, in order of preference, and defaults. ---
ALIASES = {
    "title": ("title", "subject", "name"),
    "content": ("content", "body", "text", "description"),
    "source": ("source", "source_name", "source_type", "board"),
    "category": ("category", "category_raw", "type"),
    "department": ("department", "department_name", "office"),
    "url": ("url", "original_url", "link", "href"),
    "date": ("date", "published_at", "created_at", "updated_at"),
    "id": ("id", "notice_id", "post_id", "uuid"),
}
NO_TITLE, NO_CONTENT, ATTACHMENT_NAME = "제목 없음 공지 ", "본문 정보가 비어 있습니다.", "첨부파일"

# --- Fixed values: limits. ---
CANDIDATES, PAGE_SIZE, PAGE_SIZE_MOST = 500, 20, 100
RETENTION_DAYS = 365
CATEGORIES_SHOWN, CATEGORIES_MOST, ONE_OFF_MOST = 12, 18, 0.35


@dataclass(frozen=True)
class Taxonomy:
    """Two levels: an audience by ordered rules on the joined source names, then groups within it.

    audience_rules: (audience, needles, exact); a needle is looked for in the names joined by blanks, or, if exact, must equal one of them.
    common: (audience whose group comes from category and title, ordered rules, default group).
    per_source: (audience, ordered rules for each source, default groups).
    joined: for an audience, rules on the joined names that each add a group; first_only takes the first, default is used if none matches.
    """

    audience_order: tuple[str, ...]
    group_order: tuple[str, ...]
    audience_rules: tuple[tuple[str, tuple[str, ...], bool], ...]
    default_audience: str
    common: tuple[str, tuple[tuple[str, tuple[str, ...]], ...], str]
    per_source: tuple[str, tuple[tuple[str, tuple[str, ...]], ...], tuple[str, ...]]
    joined: dict[str, tuple[tuple[tuple[str, str], ...], bool, tuple[str, ...]]] = field(default_factory=dict)
    #: Audiences in which a filter on the source counts.
    source_filter_audiences: tuple[str, ...] = ()


# --- Fixed values: the university taxonomy. ---
_DEPARTMENTS = "학부 재학생(학과/전공별)"
UNIVERSITY = Taxonomy(
    audience_order=("전 구성원 공통", _DEPARTMENTS, "신입생·저학년", "재학생 비교과·글로벌 프로그램", "취업·창업 준비생", "대학원생", "평생·전문교육원", "그 외"),
    group_order=(
        "일반", "학사", "장학/대출", "입찰", "행사", "공과대", "AI융합대", "항공경영대", "그 외 학부", "새내기성공센터", "드림칼리지디자인", "국제교류", "첨단분야 부트캠프",
        "산학협력", "교수학습센터", "대학일자리플러스센터", "학과 취업공지", "대학원", "생활관", "인권센터", "학술정보관", "LMS", "입학처", "박물관", "그 외",
    ),
    audience_rules=(
        ("취업·창업 준비생", ("신소재공학과 취업공지", "대학일자리플러스센터"), False),
        ("신입생·저학년", ("드림칼리지디자인", "새내기성공센터"), False),
        ("재학생 비교과·글로벌 프로그램", ("국제교류처", "부트캠프사업단", "산학협력단", "교수학습센터"), False),
        ("대학원생", ("대학원", "정책대학원", "경영대학원"), False),
        ("평생·전문교육원", ("평생교육원", "비행교육원", "항공교통관제교육원", "항공기술교육원", "항공안전교육원"), False),
        (_DEPARTMENTS, ("학과", "학부", "전공", "공과대학", "항공·경영대학", "항공경영대학", "AI융합대학", "인문자연학부", "자유전공학부"), False),
        ("전 구성원 공통", ("한국항공대학교 공식 홈페이지",), True),
    ),
    default_audience="그 외",
    common=(
        "전 구성원 공통",
        (("입찰", ("입찰",)), ("학사", ("학사", "수강", "졸업", "성적", "등록")), ("장학/대출", ("장학", "대출", "국가근로")), ("행사", ("행사", "특강", "설명회", "세미나"))),
        "일반",
    ),
    per_source=(
        _DEPARTMENTS,
        (
            ("공과대", ("공과대학", "항공우주공학", "기계항공공학", "항공우주및기계공학", "항공공학전공", "기계공학전공", "항공MRO전공", "우주공학전공", "신소재공학과 학부", "우주항공신소재전공", "반도체신소재전공")),
            ("AI융합대", ("AI융합대학", "AI융합ICT전공", "AI자율주행시스템공학과", "인공지능전공", "소프트웨어학과", "컴퓨터공학", "전기전자공학", "전자및항공전자전공", "항공전자정보공학부", "반도체시스템전공", "스마트드론공학과")),
            ("항공경영대", ("항공·경영대학", "항공경영대학", "항공경영", "경영학", "경영전공", "항공교통물류학부", "항공교통전공", "물류전공", "항공운항학과")),
            ("그 외 학부", ("인문자연학부", "자유전공학부")),
        ),
        ("그 외 학부",),
    ),
    joined={
        "신입생·저학년": ((("새내기성공센터", "새내기성공센터"), ("드림칼리지디자인", "드림칼리지디자인")), True, ("그 외",)),
        "재학생 비교과·글로벌 프로그램": ((("국제교류", "국제교류처"), ("첨단분야 부트캠프", "부트캠프사업단"), ("산학협력", "산학협력단"), ("교수학습센터", "교수학습센터")), False, ("그 외",)),
        "취업·창업 준비생": ((("대학일자리플러스센터", "대학일자리플러스센터"), ("학과 취업공지", "신소재공학과 취업공지")), False, ()),
        "그 외": ((("생활관", "생활관"), ("인권센터", "인권센터"), ("학술정보관", "학술정보관"), ("LMS", "LMS"), ("입학처", "입학처"), ("박물관", "항공우주박물관")), False, ()),
    },
    source_filter_audiences=(_DEPARTMENTS, "대학원생", "평생·전문교육원"),
)


@dataclass(frozen=True)
class UrlRule:
    """A detail page: if host and path fit and all `need` keys are in the query, only the `keep` keys stay, in this order, each with its last value.
    need_value: the key must be non-blank (otherwise present is enough); equals: a key that must have this value."""

    hosts: tuple[str, ...]
    exact: bool
    path_starts: tuple[str, ...]
    path_ends: str
    path_has: str = ""
    need: tuple[str, ...] = ()
    need_value: tuple[str, ...] = ()
    equals: tuple[str, str] | None = None
    keep: tuple[str, ...] = ()
    #: True: the query goes and a trailing slash of the path too.
    bare: bool = False


# --- Fixed values: detail page rules, first match wins. ---
_READ = {"need": ("mode", "seq"), "keep": ("code", "mode", "seq")}
URL_RULES = (
    UrlRule(("kau.ac.kr",), False, ("/kaulife/",), ".php", **_READ),
    UrlRule(("career.kau.ac.kr",), False, ("/ko/community/notice/", "/ko/dataroom/data/"), "", path_has="/view/", bare=True),
    UrlRule(("college.kau.ac.kr",), False, ("/web/pages/",), ".do", need_value=("bbsId", "nttId"), keep=("bbsId", "nttId", "mnuId")),
    UrlRule(("research.kau.ac.kr",), False, ("/info/",), ".php", **_READ),
    UrlRule(("ctl.kau.ac.kr",), False, ("",), "/notice/list.php", **_READ),
    UrlRule(("lib.kau.ac.kr",), False, ("",), "/sb/default_notice_view.mir", need_value=("sb_no",), keep=("sb_no",)),
    UrlRule(("ftc.kau.ac.kr",), False, ("/info/",), ".php", **_READ),
    UrlRule(
        ("fsc.kau.ac.kr", "grad.kau.ac.kr", "gradbus.kau.ac.kr", "aisw.kau.ac.kr", "ai.kau.ac.kr:8100", "ai.kau.ac.kr:8110", "ai.kau.ac.kr:8120", "ai.kau.ac.kr:8130", "ai.kau.ac.kr:8140", "sw.kau.ac.kr", "ave.kau.ac.kr"),
        True, ("",), ".php", **_READ,
    ),
    UrlRule(("lms.kau.ac.kr",), False, ("",), "/mod/ubboard/article.php", need_value=("id", "bwid"), keep=("id", "bwid")),
    UrlRule(("asbt.kau.ac.kr",), False, ("",), "/customer/notice.php", need_value=("idx",), equals=("ptype", "view"), keep=("ptype", "idx", "code")),
    UrlRule(("amtc.kau.ac.kr",), False, ("",), "/bbs/board.php", need_value=("bo_table", "wr_id"), keep=("bo_table", "wr_id")),
    UrlRule(("ibhak.kau.ac.kr",), False, ("",), "/noticeView.asp", need_value=("p_board_id", "p_board_idx"), keep=("p_board_id", "p_board_idx")),
)
