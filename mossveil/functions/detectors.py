"""Rule detectors: each turns a text column into an array of spans, within the row and the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mossveil.functions.spans import ASCII_DIGITS, DIGITS, SHORT, SPANS, ascii_digits, digit, find, find_near, group, let, near_digits, real_date, span, weighted

# ---- fixed values ----------------------------------------------------------------------------------------------
PROVINCES = (
    "서울특별시 부산광역시 대구광역시 인천광역시 광주광역시 대전광역시 울산광역시 세종특별자치시 경기도 강원특별자치도 "
    "강원도 충청북도 충청남도 전북특별자치도 전라북도 전라남도 경상북도 경상남도 제주특별자치도 제주도"
).split()
PARTICLES = "입니다 입니까 예요 였 에서 에게 으로 까지 부터 처럼 보다 조차 마저 밖에 마다 한테 의 에 로 은 는 이 가 을 를 과 와 도 만".split()
BUILDINGS = "아파트 빌라 오피스텔 맨션 타워".split()
SURNAMES = (
    "남궁 선우 제갈 황보 독고 서문 사공 김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 전 홍 유 고 문 양 손 배 백 허 남 심 "
    "노 하 곽 성 차 주 우 구 민 나 진 지 엄 채 원 천 방 공 현 함"
).split()
TITLES = "팀장 과장 부장 차장 대리 사원 실장 본부장 이사 대표 원장 교수 주임 반장 사장 회장 님".split()
ROLES = "고객 환자 신청자 작성자 담당자 수령인 수신인 성명 이름 저는".split()
HONORIFICS = "선생님 고객님 환자분 님 씨 군 양 담당자 작성자 신청자 수령인 수신인".split()
LABEL_WORDS = "전화번호 이메일 주민등록번호 주민번호 주민등록증 주소 나이 성별 생년월일 이용 이유 이사".split()
DEPARTMENTS = "구매 정기 홍보 안전 노무".split()
NAME_PARTICLES = "이가은는을를도만의에로과와"
HONORIFIC_TAILS = "님씨군양"
ACCOUNT_CUES = "계좌 입금 이체 예금주 예금 출금 송금 은행 뱅크".split()
BIRTH_ANCHORS = "출생년월일 생년월일 출생일 생일".split()
PASSPORT_CUE = "여권"
#: Also read as it stands by the SQL that checks the engine.
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,63}"
RRN_WEIGHTS = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
BUSINESS_WEIGHTS = [1, 3, 7, 1, 3, 7, 1, 3, 5]
# ----------------------------------------------------------------------------------------------------------------

#: Python's white space, which has four controls that Java's lacks.
WS = r"[\s\x1c-\x1f]"
HANGUL = "[가-힣]"
NO_DIGIT_BEFORE, NO_DIGIT_AFTER = r"(?<!\d)", r"(?!\d)"
SEP = r"[-.\s\x1c-\x1f]?"

Detector = Callable[[Column], Column]


def of_numbers(body: Callable[[Column, Column], Column]) -> Detector:
    """A detector that looks only near digits, at windows that are given or made for it alone."""

    def detector(text: Column, near: Column | None = None) -> Column:
        return body(text, near) if near is not None else let(near_digits(text), lambda windows: body(text, windows))

    detector.takes_windows = True
    detector.__doc__ = body.__doc__
    return detector


def all_spans(text: Column, near: Column, least: int, spans: Column, *patterns: str, needs: str | None = None) -> Column:
    """Spans of windows; none for null texts too, nor where no window has ``least`` digits, nor for short texts in which
    one look finds none of the patterns, or not what they ``need``."""
    seen = reduce(or_, [text.rlike(f"(?U){p}") for p in patterns])
    worth = (F.array_max(near["digits"]) >= least) & ((F.length(text) > SHORT) | (text.rlike(needs) & seen if needs else seen))
    return F.when(worth, F.coalesce(spans.cast(SPANS), F.array().cast(SPANS))).otherwise(F.array().cast(SPANS))


def with_digits(found: Column) -> Column:
    """Matches with their ASCII digits, which checks of a number ask for a dozen times."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), ascii_digits(m["match"]).alias("digits")))


def longest_first(words: list[str]) -> str:
    return "|".join(sorted(dict.fromkeys(words), key=len, reverse=True))


def any_of(words: list[str]) -> str:
    """Any of the words, the longest first; signs with which none begins are passed over at one look."""
    single = [w for w in words if len(w) == 1]
    longer = [w for w in words if len(w) > 1]
    options = [longest_first(longer)] * bool(longer) + [one_of(single)] * bool(single)
    return f"(?={one_of(w[0] for w in words)})(?:{'|'.join(options)})"


def one_of(signs: Iterable[str]) -> str:
    """A class of signs (none of them special in one) as ranges within ranges: the matcher asks for the signs of a plain
    class one after the other, for one of these only in the half that holds the sign."""
    ordered = sorted(set(signs))
    if len(ordered) <= 4:
        return f"[{''.join(ordered)}]"
    half = len(ordered) // 2
    return "[" + "".join(f"[{part[0]}-{part[-1]}&&{one_of(part)}]" for part in (ordered[:half], ordered[half:])) + "]"


def guarded(text: Column, condition: Column, spans: Column) -> Column:
    """Spans where the cheap condition holds, none elsewhere (null texts included)."""
    return F.when(condition, spans.cast(SPANS)).otherwise(F.array().cast(SPANS))


def hangul(text: Column) -> Column:
    """A cheap test for what every Korean cue consists of; it comes before the dearer tests for the cues."""
    return text.rlike(HANGUL)


@of_numbers
def rrn(text: Column, near: Column) -> Column:
    """Resident and foreigner registration numbers; 1.0 with a right check digit, else 0.85."""
    pattern = NO_DIGIT_BEFORE + r"\d{6}" + SEP + r"[1-8]\d{6}" + NO_DIGIT_AFTER
    found = with_digits(find_near(near, pattern, least=13))
    d = lambda m: m["digits"]
    century = lambda m: F.when(digit(d(m), 6).isin(1, 2, 5, 6), "19").otherwise("20")
    real = F.filter(found, lambda m: real_date(F.concat(century(m), F.substring(d(m), 1, 2)), F.substring(d(m), 3, 2), F.substring(d(m), 5, 2)))
    right = lambda m: (F.lit(11) - weighted(d(m), RRN_WEIGHTS) % 11) % 10 == digit(d(m), 12)
    return all_spans(text, near, 13, F.transform(real, lambda m: span("rrn", "RRNDetector", m["match"], m["start"], m["end"], F.when(right(m), 1.0).otherwise(0.85))), pattern)


@of_numbers
def passport(text: Column, near: Column) -> Column:
    """Passport numbers; 0.9 with the cue in the 15 characters before, else 0.6."""
    pattern = r"(?<![A-Za-z0-9])[MSROD](?:\d{8}|\d{3}[A-Z]\d{4})(?![A-Za-z0-9])"
    found = find_near(near, pattern, context=15, least=7, needs=r"(?U)[MSROD]\d{3}")
    cued = lambda m: F.contains(m["lead"], F.lit(PASSPORT_CUE))
    return all_spans(text, near, 7, F.transform(found, lambda m: span("passport", "PassportDetector", m["match"], m["start"], m["end"], F.when(cued(m), 0.9).otherwise(0.6))), pattern)


@of_numbers
def driver_license(text: Column, near: Column) -> Column:
    """Driving licence numbers of the known regions."""
    pattern = r"(?<![\d-])(?:1[1-9]|2[0-6]|28)[- ]?\d{2}[- ]?\d{6}[- ]?\d{2}(?![\d-])"
    found = find_near(near, pattern, least=12)
    return all_spans(text, near, 12, F.transform(found, lambda m: span("driver_license", "DriverLicenseDetector", m["match"], m["start"], m["end"], 0.85)), pattern)


@of_numbers
def phone(text: Column, near: Column) -> Column:
    """Mobile numbers first, then landline, internet and personal numbers."""
    rest = SEP + r"\d{3,4}" + SEP + r"\d{4}" + NO_DIGIT_AFTER
    of_mobile = NO_DIGIT_BEFORE + r"(?:\+82" + SEP + r"0?|0)1[016789]" + rest
    of_fixed = NO_DIGIT_BEFORE + r"0(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4]|70|50\d?)" + rest
    mobile, fixed = find_near(near, of_mobile, least=10), find_near(near, of_fixed, least=9)

    def spans(found: Column, separated: float, bare: float) -> Column:
        return F.transform(found, lambda m: span("phone", "PhoneDetector", m["match"], m["start"], m["end"], F.when(m["match"].rlike("[-. ]"), separated).otherwise(bare)))

    return all_spans(text, near, 9, F.concat(spans(mobile, 1.0, 0.9), spans(fixed, 0.95, 0.8)), of_mobile, of_fixed)


def email(text: Column) -> Column:
    found = find(text, EMAIL)
    return guarded(text, F.contains(text, F.lit("@")), F.transform(found, lambda m: span("email", "EmailDetector", m["match"], m["start"], m["end"], 1.0)))


#: Parts of an address behind its anchor, in order; the last three may follow a comma.
ADDRESS_GROUPS = ("gu", "gu2", "dong", "lot", "building")
ADDRESS_TAIL = (
    rf"(?:{WS}(?<gu>{HANGUL}{{1,10}}[시군구]))?"
    rf"(?:{WS}(?<gu2>{HANGUL}{{1,10}}[군구]))?"
    rf"(?:{WS}(?<dong>{HANGUL}{{1,10}}[동읍면리]|{HANGUL}{{1,10}}[로길](?:{WS}?\d{{1,4}}번?길)?))?"
    rf"(?:{WS}(?<lot>\d{{1,4}}(?:-\d{{1,4}})?)(?![\d-])(?:{WS}?호)?)?"
    rf"(?:[,\s\x1c-\x1f]{WS}*(?<building>[0-9A-Za-z가-힣]{{1,20}}(?:{'|'.join(BUILDINGS)})))?"
    rf"(?:[,\s\x1c-\x1f]{WS}*\d{{1,4}}동)?(?:[,\s\x1c-\x1f]{WS}*\d{{1,5}}호)?"
)
#: What each part adds to the confidence.
ADDRESS_WEIGHTS = {"gu": 0.15, "gu2": 0.05, "dong": 0.15, "lot": 0.2, "building": 0.15}


def address(text: Column) -> Column:
    """Addresses from a province on, and from a city or county on where no such address overlaps; by start."""
    province = find(text, f"{any_of(PROVINCES)}(?!(?!{'|'.join(PARTICLES)}){HANGUL})" + ADDRESS_TAIL, ADDRESS_GROUPS)
    city = find(text, rf"(?<!{HANGUL}){HANGUL}{{2,9}}[시군](?={WS}{HANGUL}{{1,10}}[구동읍면리])" + ADDRESS_TAIL, ADDRESS_GROUPS)

    def spans(found: Column, base: float, cap: float) -> Column:
        def score(m: Column) -> Column:
            parts = [F.when(group(m, k) != "", w).otherwise(0.0) for k, w in enumerate(ADDRESS_WEIGHTS.values())]
            return F.round(F.least(sum(parts, F.lit(base)), F.lit(cap)), 2)

        return F.transform(found, lambda m: span("address", "AddressDetector", m["match"], m["start"], m["end"], score(m)))

    # Both are found once; the province spans are asked about by every city.
    def merged(found: Column) -> Column:
        of_province, of_city = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        alone = F.filter(of_city, lambda m: (group(m, 2) != "") & ~F.exists(of_province, lambda p: (m["start"] < p["end"]) & (m["end"] > p["start"])))
        return F.concat(spans(of_province, 0.5, 1.0), spans(alone, 0.4, 0.9))

    both = let(F.array(province, city), merged)
    ordered = F.array_sort(both, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return guarded(text, text.rlike("[시군도]"), ordered)


@of_numbers
def card(text: Column, near: Column) -> Column:
    """Card numbers of 13 to 19 digits with a right Luhn digit."""
    pattern = NO_DIGIT_BEFORE + r"(?:\d{4}([ .-]{1,3})\d{4}\1\d{4}\1\d{1,4}|\d{4}([ .-]{1,3})\d{6}\2\d{5}|\d{13,19})" + NO_DIGIT_AFTER
    found = with_digits(find_near(near, pattern, least=13))
    d = lambda m: m["digits"]
    right = F.filter(found, lambda m: F.length(d(m)).between(13, 19) & F.call_function("luhn_check", d(m)))
    return all_spans(text, near, 13, F.transform(right, lambda m: span("card", "CreditCardDetector", m["match"], m["start"], m["end"], 0.95)), pattern)


@of_numbers
def account(text: Column, near: Column) -> Column:
    """Account numbers of 10 to 14 digits with a cue within 15 characters."""
    pattern = r"(?<![\d-])(?:\d{2,7}(?:-\d{2,7}){1,3}|\d{10,14})(?![\d-])"
    found = find_near(near, pattern, context=15, least=10, needs="|".join(ACCOUNT_CUES))
    kept = F.filter(found, lambda m: F.length(ascii_digits(m["match"])).between(10, 14) & m["context"].rlike("|".join(ACCOUNT_CUES)))
    return all_spans(text, near, 10, F.transform(kept, lambda m: span("account", "AccountDetector", m["match"], m["start"], m["end"], 0.6)), pattern, needs=any_of(ACCOUNT_CUES))


@of_numbers
def business_registration(text: Column, near: Column) -> Column:
    """Business registration numbers with a right check digit."""
    pattern = NO_DIGIT_BEFORE + r"\d{3}-\d{2}-\d{5}" + NO_DIGIT_AFTER
    found = with_digits(find_near(near, pattern, least=10, needs=r"(?U)\d-\d"))
    d = lambda m: m["digits"]
    total = lambda m: weighted(d(m), BUSINESS_WEIGHTS) + F.floor(digit(d(m), 8) * 5 / 10)
    right = F.filter(found, lambda m: (F.lit(10) - total(m) % 10) % 10 == digit(d(m), 9))
    return all_spans(text, near, 10, F.transform(right, lambda m: span("biz_reg", "BusinessRegistrationDetector", m["match"], m["start"], m["end"], 1.0)), pattern)


#: Takes nothing, and keeps what follows, as long as the longest label word.
AHEAD = r"(?=(?<ahead>[\s\S]{0,6}))"
SURNAME_HEADS = one_of(s[0] for s in SURNAMES)
#: Any word that makes a name of what stands beside it.
CUE = any_of(ROLES + HONORIFICS + TITLES)
TITLE_ONLY = [t for t in TITLES if t not in HONORIFICS]


def name(text: Column, min_confidence: float = 0.0) -> Column:
    """Names by surname and cues: 0.75 with cues on both sides, 0.5 with one."""
    pattern = (
        rf"(?<lead>(?:(?<prefix>{any_of(ROLES + TITLE_ONLY)})[:\s\x1c-\x1f]{{1,2}})?)(?<!{HANGUL})(?={SURNAME_HEADS}){AHEAD}"
        rf"(?<name>{any_of(SURNAMES)}{HANGUL}(?:(?![{HONORIFIC_TAILS}]){HANGUL})?)"
        rf"(?:{WS}?(?<suffix>{any_of(HONORIFICS + TITLES)}))?"
    )
    found = find(text, pattern, ("lead", "prefix", "name", "suffix", "ahead"))
    at = lambda m: m["start"] + F.length(group(m, 0))
    prefix, called, suffix = (lambda m: group(m, 1)), (lambda m: group(m, 2)), (lambda m: group(m, 3))
    label = lambda m: group(m, 4).rlike(f"^(?:{'|'.join(LABEL_WORDS)})")
    only_title = lambda m: (suffix(m).isin(TITLE_ONLY) & (prefix(m) == "")) | (prefix(m).isin(TITLE_ONLY) & (suffix(m) == ""))
    department = lambda m: called(m).rlike(f"^(?:{'|'.join(DEPARTMENTS)})[{NAME_PARTICLES}]$")
    good = F.filter(found, lambda m: ~label(m) & ((prefix(m) != "") | (suffix(m) != "")) & ~(only_title(m) & ((F.length(called(m)) < 3) | department(m))))
    score = lambda m: F.when((prefix(m) != "") & (suffix(m) != ""), 0.75).otherwise(0.5)
    spans = F.transform(F.filter(good, lambda m: score(m) >= min_confidence), lambda m: span("name", "NameDetector", called(m), at(m), at(m) + F.length(called(m)), score(m)))
    return guarded(text, ((F.length(text) <= SHORT) | hangul(text)) & text.rlike(CUE), spans)


def name_candidate(text: Column) -> Column:
    """Whether a text may hold a name at all: any cue, or a surname and a syllable that begin no label word."""
    found = find(text, f"(?={SURNAME_HEADS}){AHEAD}{any_of(SURNAMES)}{HANGUL}", ("ahead",))
    loose = F.exists(found, lambda m: ~group(m, 0).rlike(f"^(?:{'|'.join(LABEL_WORDS)})"))
    return F.coalesce(text.rlike(CUE) | loose, F.lit(False))


@of_numbers
def birth_date(text: Column, near: Column) -> Column:
    """Real dates behind a birth label; the span is the date."""
    day = rf"\d{{4}}{WS}?년{WS}?\d{{1,2}}{WS}?월{WS}?\d{{1,2}}{WS}?일|\d{{4}}[-./]\d{{1,2}}[-./]\d{{1,2}}"
    pattern = rf"(?<lead>{any_of(BIRTH_ANCHORS)}[:\s\x1c-\x1f]{{0,10}}(?:은|는|이|가)?{WS}{{0,5}})(?<date>{day})"
    found = find_near(near, pattern, ("lead", "date"), least=6, needs="|".join(BIRTH_ANCHORS))
    part = lambda m, k: F.translate(F.get(F.split(F.regexp_replace(group(m, 1), r"(?U)\D+", "-"), "-"), F.lit(k)), "".join(DIGITS), ASCII_DIGITS)
    real = F.filter(found, lambda m: real_date(part(m, 0), part(m, 1), part(m, 2)))
    at = lambda m: m["start"] + F.length(group(m, 0))
    return all_spans(text, near, 6, F.transform(real, lambda m: span("birth_date", "BirthDateDetector", group(m, 1), at(m), m["end"], 0.9)), pattern)


#: The default set; the order breaks ties when spans overlap.
DEFAULT: dict[str, Detector] = {
    "rrn": rrn,
    "passport": passport,
    "driver_license": driver_license,
    "phone": phone,
    "email": email,
    "address": address,
    "card": card,
    "account": account,
    "biz_reg": business_registration,
    "name": name,
    "birth_date": birth_date,
}
