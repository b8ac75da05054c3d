"""Columns derived from a notice: life cycle, labels, sections, formats.  `now` is always given by the caller."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and rule tables of the domain, in order of priority.
PUBLIC_BID, GOV_SUPPORT = "공공입찰", "정부지원"
GOV_CHANNELS = ("IRIS", "과학기술정보통신부")
CHANNEL_PREFIXES = ("나라장터", "IRIS", "K-water", "과학기술정보통신부")
PLAN_STAGE, PRE_STAGE = "발주계획", "사전규격"
WORK_TYPE_RULES = (
    ("유지보수", ("유지보수", "하자보수", "보수")),
    ("임대", ("임대", "렌탈", "대여")),
    ("운영", ("운영", "위탁운영", "관제 용역", "청소용역", "안전점검")),
    ("감리", ("감리",)),
    ("구매", ("구매", "구입", "보급", "공급")),
    ("공사", ("공사", "신설", "증설", "리모델링", "개보수")),
    ("연구", ("연구", "R&D", "연구개발")),
    ("고도화", ("고도화",)),
    ("개발", ("개발", "개선")),
    ("구축", ("구축", "도입", "설치")),
)
ORG_RULES = (
    ("보건의료", ("병원", "의료원", "보건소", "건강보험", "질병관리", "적십자", "한의원")),
    ("농림수산", ("농어촌공사", "농업기술원", "산림조합", "수산업협동조합", "수협", "축산", "임업", "산림청", "농촌진흥")),
    ("국방치안", ("국방부", "육군", "해군", "공군", "해병", "부대", "경찰청", "해양경찰", "교정청", "교도소", "방위사업청")),
    ("교육", ("교육청", "교육지원청", "대학교", "대학", "고등학교", "중학교", "초등학교", "산학협력단", "교육연구원", "폴리텍")),
    ("문화체육관광", ("문화재단", "관광재단", "체육회", "도서관", "박물관", "미술관", "문화원", "영상물등급위원회", "예술")),
    ("에너지환경", ("환경공단", "수자원공사", "에너지공단", "한국전력", "한전", "가스공사", "자원공사", "환경연구원", "기후")),
    ("건설교통", ("국토교통부", "도로", "철도", "공항", "항만", "건설", "토지주택공사", "교통공사", "SR", "도시공사")),
    ("정보통신방송", ("정보통신", "방송통신", "과학기술정보통신부", "우정사업본부", "전파", "ICT")),
    ("산업통상과학기술", ("산업진흥원", "기술원", "연구원", "특허", "표준", "중소벤처", "산업기술", "산업단지공단", "발명")),
    ("복지가족여성", ("여성가족", "복지관", "아동", "장애인", "노인복지")),
    ("금융경제", ("신용보증기금", "금융위원회", "경제진흥원", "신용보증재단", "기술보증기금")),
    ("지방행정", ("특별시", "광역시", "특별자치도", "특별자치시", "도청", "시청", "군청", "구청")),
)
ADMIN_CATEGORY, ADMIN_SUFFIXES = "지방행정", ("도", "시", "군", "구")
BOARD_WORDS = r"(?i)(board|bbs|notice|news|article|list)"
FILE_KINDS = ("pdf", "hwpx", "hwp", "pptx", "xlsx", "zip")
STALE_MINUTES, COMPLIANCE_DAYS = 60, 90


def closed(close: Column, now: Column) -> Column:
    """Closed at or before now; an unknown end is not closed."""
    return F.coalesce(close <= now, F.lit(False))


def bid_status(start: Column, close: Column, now: Column) -> Column:
    return F.when(closed(close, now), "closed").when(start.isNull(), "unscheduled").when(start > now, "upcoming").otherwise("in_progress")


def any_of(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found |= text.contains(word)
    return found


def first_rule(text: Column, rules) -> Column:
    """Name of the first rule of which a word stands in the text; null if none does."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in rules:
        chain = chain.when(any_of(text, words), name)
    return chain


def work_type(title: Column, rules=WORK_TYPE_RULES) -> Column:
    return first_rule(title, rules)


def org_category(name: Column, rules=ORG_RULES, suffixes=ADMIN_SUFFIXES, admin=ADMIN_CATEGORY) -> Column:
    """First rule that fits; else by the ending of the last word, of two characters or more."""
    last = F.element_at(F.split(F.trim(name), r"\s+"), -1)
    ends = F.lit(False)
    for suffix in suffixes:
        ends |= last.endswith(suffix)
    return F.coalesce(first_rule(name, rules), F.when((F.length(last) >= 2) & ends, admin))


def notice_type(channel: Column, gov_channels=GOV_CHANNELS) -> Column:
    return F.when(channel.isin(*gov_channels), GOV_SUPPORT).otherwise(PUBLIC_BID)


def status_label(kind: Column, stage: Column, status: Column, early_stages=(PRE_STAGE, PLAN_STAGE)) -> Column:
    support = F.when(status == "closed", "접수마감").when(status == "in_progress", "접수중").otherwise("접수예정")
    bid = F.when(stage.isin(*early_stages), stage).when(status == "closed", "입찰마감").otherwise("입찰공고")
    return F.when(kind == GOV_SUPPORT, support).otherwise(bid)


def work_type_label(kind: Column, biz_type: Column) -> Column:
    return F.when(kind == GOV_SUPPORT, "개발").otherwise(F.coalesce(F.nullif(biz_type, F.lit("")), F.lit("미상")))


def section(stage: Column, kind: Column, status: Column, pre_stage: str = PRE_STAGE, plan_stage: str | None = None) -> Column:
    """prenotice or active; plan as well if a plan stage is given (the form of letters)."""
    chain = F.when(stage == plan_stage, "plan") if plan_stage else F.when(F.lit(False), "plan")
    early = (stage == pre_stage) | ((kind == GOV_SUPPORT) & status.isin("upcoming", "unscheduled"))
    return chain.when(early, "prenotice").otherwise("active")


def strength_label(strength: Column) -> Column:
    return F.when(strength >= 0.66, "강한 일치").when(strength >= 0.33, "보통 일치").otherwise("약한 일치")


def tenths(value: Column) -> Column:
    """A double to one decimal as C's printf rounds it: by its exact binary value, ties to even.  Java's formatter takes the shortest decimal and rounds ties up."""
    part = value % 1
    # Ten times the part is exactly total + rest.
    high, low = part * 8, part * 2
    total = high + low
    rest = low - (total - high)
    nearest = F.when((total % 1 == 0.5) & (rest != 0), total + F.signum(rest) / 2).otherwise(F.rint(total))
    return F.format_string("%.1f", ((value - part) * 10 + nearest) / 10)


def price_label(value: Column) -> Column:
    hundred_million, ten_thousand = (value / 100_000_000).cast("double"), (value / 10_000).cast("double")
    large = F.concat(tenths(hundred_million), F.lit("억원"))
    small = F.concat(F.format_string("%.0f", F.rint(ten_thousand)), F.lit("만원"))
    return F.when(value.isNull(), "미공개").when(hundred_million >= 1, large).otherwise(small)


def kst_date(ts: Column) -> Column:
    """Calendar date in Korea of an instant kept as UTC."""
    return F.to_date(ts + F.expr("INTERVAL 9 HOURS"))


def days_left(close: Column, now: Column) -> Column:
    """Calendar days to the end in Korea; null once past."""
    days = F.datediff(kst_date(close), kst_date(now))
    return F.when(days >= 0, days)


def dday_label(close: Column, now: Column) -> Column:
    days = days_left(close, now)
    return F.when(days == 0, "D-Day").when(days > 0, F.concat(F.lit("D-"), days.cast("string")))


def period_label(raw: Column) -> Column:
    """Years and months before a bracket as total years and months; the raw text if there is no number."""
    head = F.substring_index(raw, "(", 1)
    years, months = (F.regexp_extract(head, rf"(\d+)\s*{unit}", 1) for unit in ("년", "개월"))
    total = F.coalesce(F.expr("0"), F.lit(0)) + F.coalesce(F.nullif(years, F.lit("")).cast("int") * 12, F.lit(0)) + F.coalesce(F.nullif(months, F.lit("")).cast("int"), F.lit(0))
    y, m = F.floor(total / 12), total % 12
    text = F.concat_ws(" ", F.when(y > 0, F.concat(y.cast("string"), F.lit("년"))), F.when(m > 0, F.concat(m.cast("string"), F.lit("개월"))))
    return F.when(total > 0, text).otherwise(raw)


def agency_status(source_id: Column, active: Column, run_status: Column) -> Column:
    return F.when(source_id.isNull(), "no_source").when(~active, "inactive").when(run_status.isNull(), "no_run_yet").otherwise(run_status)


def source_status(active: Column, run_status: Column, run_at: Column, now: Column, minutes: int = STALE_MINUTES) -> Column:
    """A run that has been running for over an hour counts as failed."""
    stale = (run_status == "running") & (run_at < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return F.when(~active, "inactive").when(run_status.isNull(), "no_run_yet").when(stale, "fail").otherwise(run_status)


def compliance_overdue(verified: Column, now: Column, days: int = COMPLIANCE_DAYS) -> Column:
    return verified.isNull() | (verified < now - F.expr(f"INTERVAL {days} DAYS"))


def channel_name(source_name: Column, org_name: Column, prefixes=CHANNEL_PREFIXES) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix in prefixes:
        chain = chain.when(source_name.startswith(prefix), prefix)
    return F.coalesce(chain, F.nullif(org_name, F.lit("")), source_name)


def board_like(url: Column) -> Column:
    part = lambda what: F.coalesce(F.try_parse_url(url, F.lit(what)).rlike(BOARD_WORDS), F.lit(False))
    return part("PATH") | part("QUERY")


def file_kind(name: Column, kinds=FILE_KINDS) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind in kinds:
        chain = chain.when(F.lower(name).endswith(f".{kind}"), kind)
    return chain.otherwise("other")


def disposition_name(header: Column, fallback: Column) -> Column:
    """File name of a content-disposition header, decoded; the fallback if there is none."""
    found = F.regexp_extract(header, r"(?i)filename\*?=(?:UTF-8'')?\"?([^\";]+)\"?", 1)
    return F.coalesce(F.nullif(F.trim(F.try_url_decode(found)), F.lit("")), fallback)


def embedding_text(*parts: Column, attachment: Column) -> Column:
    head = F.concat_ws(" · ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.when(F.length(attachment) > 0, F.concat(head, F.lit("\n\n"), attachment)).otherwise(head)


def notice_date(extra: Column, start: Column) -> Column:
    """The date text of a notice: two keys of its attributes (a map), then its start."""
    return F.coalesce(F.try_element_at(extra, F.lit("ancmDe")), F.try_element_at(extra, F.lit("nticeDt")), F.date_format(start, "yyyy-MM-dd"))
