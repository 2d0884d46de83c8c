"""A labelled corpus by construction: sentences with one value each, made from integer keys.

The SQL is kept to what Spark and DuckDB share, so both make the same sentences; where a value begins and ends
follows from the lengths of what stands before it and of itself, independent of any pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossveil.functions.detectors import BUSINESS_WEIGHTS, RRN_WEIGHTS

#: For each kind of sentence: what stands before, the value, what stands after, and the confidence of its own detector
#: (null: not found). ``k`` is the key. By the ending of the kind, ``_none`` holds no personal data and nothing to be
#: found, ``_trap`` none but something that is found all the same, ``_missed`` some that no rule finds, and
#: ``_partial`` some of which only the first ``part`` characters are found.


def pad(expr: str, n: int) -> str:
    return f"lpad(CAST(({expr}) % {10**n} AS VARCHAR(20)), {n}, '0')"


def pick(expr: str, words: list[str]) -> str:
    return f"CASE CAST(({expr}) % {len(words)} AS INT) " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def dot(value: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(substr({value}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"


RRN12 = f"{pad('k', 2)} || {pad('1 + k % 12', 2)} || {pad('1 + k % 28', 2)} || CAST(1 + k % 8 AS VARCHAR(1)) || {pad('k * 7919', 5)}"
RRN_CHECK = f"CAST((11 - {dot('b', RRN_WEIGHTS)} % 11) % 10 AS INT)"
BRN9 = f"{pad('100 + k * 37', 3)} || {pad('10 + k * 13', 2)} || {pad('k * 577', 4)}"
BRN_CHECK = f"CAST((10 - ({dot('b', BUSINESS_WEIGHTS)} + CAST(floor(CAST(substr(b, 9, 1) AS INT) * 5 / 10) AS INT)) % 10) % 10 AS INT)"
CARD15 = f"'4' || {pad('k * 104729', 7)} || {pad('k * 1299709', 7)}"


def luhn_check(value: str) -> str:
    terms = []
    for i in range(15):
        d = f"CAST(substr({value}, {i + 1}, 1) AS INT)"
        terms.append(f"CASE WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END" if i % 2 == 0 else d)
    return f"CAST((10 - ({' + '.join(terms)}) % 10) % 10 AS INT)"


def luhn_13(value: str) -> str:
    """Whether a string of 13 digits is a card number by its check digit."""
    digits = [f"CAST(substr({value}, {i + 1}, 1) AS INT)" for i in range(13)]
    terms = [f"CASE WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END" if i % 2 else d for i, d in enumerate(digits)]
    return f"({' + '.join(terms)}) % 10 = 0"


def rows(kind: str, before: str, value: str, after: str, confidence: str, body: str = "''", where: str = "true", part: str = "length(value)") -> str:
    return f"SELECT *, CAST({part} AS INT) AS part FROM (SELECT k, '{kind}' AS kind, {before} AS before, {value} AS value, {after} AS after, CAST({confidence} AS DOUBLE) AS confidence FROM (SELECT k, {body} AS b FROM keys) WHERE {where})"


SENTENCES = [
    rows("rrn", "'주민번호는 '", f"substr(b, 1, 6) || {pick('k', ['-', '.', ' ', ''])} || substr(b, 7, 6) || CAST(({RRN_CHECK} + CASE WHEN k % 3 = 0 THEN 1 + k % 9 ELSE 0 END) % 10 AS VARCHAR(1))", "' 입니다'", "CASE WHEN k % 3 = 0 THEN 0.85 ELSE 1.0 END", RRN12),
    rows("rrn_none", "'참조 '", f"{pad('k', 2)} || {pad('13 + k % 7', 2)} || {pad('1 + k % 28', 2)} || '-1' || {pad('k * 7919', 6)}", "' 입니다'", "CAST(NULL AS DOUBLE)"),
    rows("phone", "'연락처 '", f"'010' || {pick('k', ['-', '.', ' ', ''])} || {pad('1000 + k * 31', 4)} || {pick('k', ['-', '.', ' ', ''])} || {pad('k * 7', 4)}", "' 로 전화'", "CASE WHEN k % 4 = 3 THEN 0.9 ELSE 1.0 END"),
    rows("phone", "'사무실 '", f"{pick('k', ['02', '031', '042', '055', '061', '070', '0507'])} || {pick('k', ['-', '', '.'])} || {pad('100 + k * 11', 3)} || {pick('k', ['-', '', '.'])} || {pad('k * 13', 4)}", "' 로 문의'", "CASE WHEN k % 3 = 1 THEN 0.8 ELSE 0.95 END", where="k % 3 <> 1 OR k % 7 < 6"),
    rows("phone_none", "'번호 '", f"{pick('k', ['07', '08', '09', '00'])} || '-' || {pad('100 + k', 3)} || '-' || {pad('k', 4)}", "' 확인'", "CAST(NULL AS DOUBLE)"),
    rows("email", "'문의는 '", f"'user.' || CAST(k AS VARCHAR(20)) || '+x@mail' || CAST(k % 9 AS VARCHAR(2)) || '.example.co.kr'", "' 로'", "1.0"),
    rows("card", "'결제 카드 '", f"substr(c, 1, 4) || s || substr(c, 5, 4) || s || substr(c, 9, 4) || s || substr(c, 13, 4)", "' 승인'", "0.95").replace("FROM (SELECT k, '' AS b FROM keys)", f"FROM (SELECT k, b || CAST({luhn_check('b')} AS VARCHAR(1)) AS c, {pick('k', ['-', ' ', '.', ''])} AS s FROM (SELECT k, {CARD15} AS b FROM keys))"),
    rows("card_none", "'번호 '", f"b || CAST(({luhn_check('b')} + 1 + k % 9) % 10 AS VARCHAR(1))", "' 확인'", "CAST(NULL AS DOUBLE)", CARD15),
    rows("biz_reg", "'사업자 '", f"substr(b, 1, 3) || '-' || substr(b, 4, 2) || '-' || substr(b, 6, 4) || CAST({BRN_CHECK} AS VARCHAR(1))", "' 확인'", "1.0", BRN9),
    rows("biz_reg_none", "'번호 '", f"substr(b, 1, 3) || '-' || substr(b, 4, 2) || '-' || substr(b, 6, 4) || CAST(({BRN_CHECK} + 1 + k % 9) % 10 AS VARCHAR(1))", "' 확인'", "CAST(NULL AS DOUBLE)", BRN9),
    rows("passport", f"{pick('k', ['여권 ', '참조코드 '])}", f"{pick('k', ['M', 'S', 'R', 'O', 'D'])} || {pick('k', [chr(39) + ' || ' + pad('k * 7919', 8) + ' || ' + chr(39), chr(39) + ' || ' + pad('k * 3', 3) + ' || ' + chr(39) + 'A' + chr(39) + ' || ' + pad('k * 71', 4) + ' || ' + chr(39)])}", "' 확인'", "CASE WHEN k % 2 = 0 THEN 0.9 ELSE 0.6 END"),
    rows("driver_license", "'면허 '", f"{pick('k', ['11', '12', '19', '20', '26', '28'])} || '-' || {pad('k', 2)} || '-' || {pad('k * 7919', 6)} || '-' || {pad('k * 3', 2)}", "' 확인'", "0.85"),
    rows("account", "'급여는 국민은행 '", f"{pad('100 + k', 3)} || '-' || {pad('k * 31', 6)} || '-' || {pad('k', 2)} || '-' || {pad('k * 7', 3)}", "'로 지급'", "0.6"),
    rows("account_none", "'상품코드 '", f"{pad('100 + k', 3)} || '-' || {pad('k * 31', 6)} || '-' || {pad('k', 2)} || '-' || {pad('k * 7', 3)}", "' 확인'", "CAST(NULL AS DOUBLE)"),
    rows("birth_date", "'근로자 생년월일은 '", f"CAST(1950 + k % 60 AS VARCHAR(4)) || {pick('k', ['년 ', '-', '.'])} || CAST(1 + k % 12 AS VARCHAR(2)) || {pick('k', ['월 ', '-', '.'])} || CAST(1 + k % 28 AS VARCHAR(2)) || {pick('k', ['일', '', ''])}", "'이다'", "0.9"),
    rows("birth_date_none", "'계약일 '", "CAST(1950 + k % 60 AS VARCHAR(4)) || '-' || CAST(1 + k % 12 AS VARCHAR(2)) || '-' || CAST(1 + k % 28 AS VARCHAR(2))", "' 체결'", "CAST(NULL AS DOUBLE)"),
    rows("address", "'배송지는 '", f"{pick('k', ['서울특별시', '경기도', '제주특별자치도'])} || {pick('k', ['', ' 강남구', ' 성남시 분당구'])} || CASE WHEN k % 3 = 0 THEN '' ELSE {pick('k', [' 역삼동', ' 판교로'])} || ' ' || CAST(1 + k % 900 AS VARCHAR(4)) END", "' 입니다'", "CASE k % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.0 END"),
    rows("address_none", "'어제 '", f"{pick('k', ['서울특별시청', '부산광역시장', '경기도민'])}", "' 발표'", "CAST(NULL AS DOUBLE)"),
    rows("name", "'고객 '", f"{pick('k', ['김', '박', '남궁', '최'])} || {pick('k', ['철', '서', '민'])} || {pick('k', ['수', '연', '호', '진', '영'])}", "'님 방문'", "0.75"),
    rows("name_none", "'오늘 '", f"{pick('k', ['김밥을', '이유를', '정말로'])}", "' 먹었다'", "CAST(NULL AS DOUBLE)"),
    rows("passport_trap", "'부품코드 '", f"{pick('k', ['M', 'S', 'D'])} || {pad('k * 7919', 8)}", "' 재고'", "0.6"),
    rows("driver_license_trap", "'문서 '", f"{pick('k', ['11', '15', '26'])} || '-' || {pad('k', 2)} || '-' || {pad('k * 31', 6)} || '-' || {pad('k * 7', 2)}", "' 보관'", "0.85"),
    rows("driver_license_none", "'문서 '", f"{pick('k', ['27', '29', '10'])} || '-' || {pad('k', 2)} || '-' || {pad('k * 31', 6)} || '-' || {pad('k * 7', 2)}", "' 보관'", "NULL"),
    rows("name_missed", "'어제 '", f"{pick('k', ['김', '박', '최'])} || {pick('k', ['철', '서', '민'])} || {pick('k', ['수', '연', '호', '진', '영'])}", "' 만났다'", "NULL"),
    rows("address_partial", "'배송지는 '", "'경기도 성남시 분당구 ' || " + pick("k", ["꽃집 위층", "새 건물 옆"]), "' 입니다'", "0.7", part="11"),
]

KEYS = "SELECT c_custkey AS k FROM customer"
NUMBERED = " UNION ALL ".join(f"(SELECT {i} AS n, * FROM ({sql}))" for i, sql in enumerate(SENTENCES))
#: A registration number without separators and with a wrong check digit is a card number where its digits pass that
#: test; the card detector is surer, so the number is found as a card.
AS_CARD = f"CASE WHEN kind = 'rrn' AND confidence < 0.9 AND length(value) = 13 THEN {luhn_13('value')} ELSE false END"
CORPUS = f"""WITH keys AS ({KEYS}), made AS ({NUMBERED}),
named AS (SELECT *, regexp_replace(kind, '_(none|trap|missed|partial)$', '') AS base, {AS_CARD} AS as_card FROM made)
SELECT n, k, k * 100 + n AS doc_id, kind, base, before, value, after, confidence, part,
 NOT (kind LIKE '%_none' OR kind LIKE '%_trap') AS truth,
 CASE WHEN as_card THEN 'card' WHEN confidence IS NOT NULL THEN base END AS found,
 CASE WHEN as_card THEN 0.95 ELSE confidence END AS found_confidence FROM named"""


#: Values that two detectors find in part: a phone number that begins before an account number and ends within it (neither
#: holds the other), and one that an account number begins with and outlasts. Both are joined; the phone is the surer.
OVERLAPS = [
    "SELECT 100 AS n, k, '계좌 ' AS before, '+8210-' || " + pad("1000 + k * 31", 4) + " || '-' || " + pad("k * 7", 4) + " || '-' || " + pad("k", 2) + " AS value, ' 확인' AS after, 'phone' AS base, 1.0 AS found_confidence FROM keys",
    "SELECT 101 AS n, k, '계좌 ' AS before, '02-' || " + pad("100 + k % 800", 3) + " || '-' || " + pad("k * 13", 4) + " || '-' || " + pad("k", 2) + " AS value, ' 확인' AS after, 'account' AS base, 0.95 AS found_confidence FROM keys",
]
#: Sentences that may stand beside any other: no cue of theirs, or for theirs, is in reach of another's value.
BESIDE = [i for i, sql in enumerate(SENTENCES) if "'account" not in sql]
NONE = [i for i in BESIDE if "_none'" in SENTENCES[i]]
CHOSEN = BESIDE + [100, 101]


def nth(expr: str, numbers: list[int]) -> str:
    return f"CASE CAST(({expr}) % {len(numbers)} AS INT) " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(numbers)) + " END"


#: Documents: a quarter without personal data, and of the rest 15 in 100 of three sentences; which ones follows from the key.
PLACES = f"""SELECT k, CASE WHEN k * 7919 % 100 < 25 THEN 'negative' WHEN k % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty, pos,
 CASE WHEN k * 7919 % 100 < 25 THEN {nth('k', NONE)} WHEN pos = 0 THEN {nth('k', CHOSEN)} WHEN pos = 1 THEN {nth('k * 5 + 3', CHOSEN)} ELSE {nth('k * 11 + 7', CHOSEN)} END AS n
 FROM keys CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2) WHERE pos = 0 OR (k * 7919 % 100 >= 25 AND k * 104729 % 100 < 15)"""
PLACED = f"""WITH keys AS ({KEYS}), c AS (SELECT n, k, before, value, after, base, part, truth, found, CAST(found_confidence AS DOUBLE) AS found_confidence FROM ({CORPUS})
 UNION ALL SELECT n, k, before, value, after, base, CAST(length(value) AS INT), true, 'phone', CAST(found_confidence AS DOUBLE) FROM ({' UNION ALL '.join(f'({sql})' for sql in OVERLAPS)})),
places AS ({PLACES}) SELECT p.k AS doc_id, p.pos, p.difficulty, c.before, c.value, c.after, c.base, c.part, c.truth, c.found, c.found_confidence FROM places p JOIN c ON c.k = p.k AND c.n = p.n"""
#: The same with the place at which each sentence begins, sentences being joined by one blank.
SHIFTED = f"SELECT *, CAST(coalesce(sum(length(before) + length(value) + length(after) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS shift FROM ({PLACED})"


def composed(select: str) -> str:
    """SQL over the documents of one or several sentences: ``c`` has a row a sentence, with ``shift``."""
    return f"WITH c AS ({SHIFTED}) {select}"


def compose(rows: DataFrame) -> DataFrame:
    """``doc_id, text, labels, difficulty`` of documents out of their sentences (``doc_id, pos, before, value, after,
    base, truth, difficulty``), joined by one blank each. A fold over the few sentences of a document carries the
    place at which the next one begins, so labels are placed by construction."""
    sentence = F.struct("pos", F.concat("before", "value", "after").alias("text"), F.length("before").alias("before"), F.length("value").alias("size"), F.when(F.col("truth"), F.col("base")).alias("kind"))
    docs = rows.groupBy("doc_id", "difficulty").agg(F.sort_array(F.collect_list(sentence)).alias("parts"))
    label = "array<struct<kind:string,start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(label).alias("labels"))

    def step(state, s):
        begin = state["at"] + s["before"]
        one = F.when(s["kind"].isNotNull(), F.array(F.struct(s["kind"].alias("kind"), begin.alias("start"), (begin + s["size"]).alias("end")))).otherwise(F.array().cast(label)).cast(label)
        return F.struct((state["at"] + F.length(s["text"]) + 1).alias("at"), F.concat(state["labels"], one).alias("labels"))

    return docs.select("doc_id", F.array_join(F.transform("parts", lambda s: s["text"]), " ").alias("text"), F.aggregate("parts", start, step, lambda s: s["labels"]).alias("labels"), "difficulty")


def gold(select: str, kinds: str = "true") -> str:
    """SQL over the corpus: ``c`` has the columns of CORPUS."""
    return f"WITH c AS (SELECT * FROM ({CORPUS}) WHERE {kinds}) {select}"
