"""Labelled documents made by a random generator, as a Spark data source.

``spark.read.format("mossveil_corpus").option("count", 500).option("seed", 42).load()`` gives ``doc_id, text, labels,
difficulty``. Every document follows from the seed and its number alone, so it is the same however the numbers are
dealt to partitions, and when a task runs again.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mossveil.functions.detectors import BUSINESS_WEIGHTS, RRN_WEIGHTS

SCHEMA = "doc_id long, text string, labels array<struct<kind:string,start:int,end:int>>, difficulty string"
NEGATIVE, MULTI = 0.25, 0.15
#: Regions of driving licences, of this engine's reading of the pattern.
REGIONS = [*range(11, 27), 28]


# ---- values: every maker takes a random generator and whether the form is hard -------------------------------------
def digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def luhn(payload: str) -> int:
    doubled = [int(d) * (2 - i % 2) for i, d in enumerate(reversed(payload))]
    return -sum(d // 10 + d % 10 for d in doubled) % 10


def rrn_check(front: str) -> int:
    return (11 - sum(int(d) * w for d, w in zip(front, RRN_WEIGHTS)) % 11) % 10


def business_check(front: str) -> int:
    return -(sum(int(d) * w for d, w in zip(front, BUSINESS_WEIGHTS)) + int(front[8]) * 5 // 10) % 10


def name(rng: random.Random, hard: bool) -> str:
    return rng.choice("김 이 박 최 정 강 조 윤 장 임".split()) + "".join(rng.sample("민서준우현경태윤아린", 1 if hard else 2))


def phone(rng: random.Random, hard: bool) -> str:
    if hard:
        return f"+82{rng.choice(['-', ' ', ''])}10{digits(rng, 8)}" if rng.random() < 0.5 else "010" + digits(rng, 8)
    return f"{rng.choice(['010', '02', '031', '051', '064', '070'])}-{rng.randint(100, 9999)}-{digits(rng, 4)}"


def email(rng: random.Random, hard: bool) -> str:
    user = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    return f"{user}{'.' + user[:2] + '+' + digits(rng, 2) if hard else ''}@{'team.' if hard else ''}example.{'co.kr' if hard else 'com'}"


def rrn(rng: random.Random, hard: bool) -> str:
    year, month, day = rng.randint(1940, 2015), rng.randint(1, 12), rng.randint(1, 28)
    front = f"{year % 100:02d}{month:02d}{day:02d}{rng.choice('1256' if year < 2000 else '3478')}{digits(rng, 5)}"
    return f"{front[:6]}{'' if hard else '-'}{front[6:]}{rrn_check(front)}"


def card(rng: random.Random, hard: bool) -> str:
    front = "4" + digits(rng, 14)
    return ("" if hard else "-").join(f"{front}{luhn(front)}"[i : i + 4] for i in range(0, 16, 4))


def biz_reg(rng: random.Random, hard: bool) -> str:
    front = f"{rng.randint(100, 999)}{rng.randint(10, 99)}{digits(rng, 4)}"
    return f"{front[:3]}-{front[3:5]}-{front[5:]}{business_check(front)}"


def passport(rng: random.Random, hard: bool) -> str:
    return rng.choice("MSROD") + (f"{digits(rng, 3)}{rng.choice('ABCDEFGH')}{digits(rng, 4)}" if hard else digits(rng, 8))


def account(rng: random.Random, hard: bool) -> str:
    # Eleven digits are no card, no licence and no registration number, whatever they are.
    groups = ["1" + digits(rng, 2), digits(rng, 2), digits(rng, 6)]
    return ("" if hard else "-").join(groups)


def birth_date(rng: random.Random, hard: bool) -> str:
    year, month, day = rng.randint(1930, 2020), rng.randint(1, 12), rng.randint(1, 28)
    return f"{year}년{month}월{day}일" if hard and rng.random() < 0.5 else f"{year}{'/' if hard else '-'}{month:02d}{'/' if hard else '-'}{day:02d}"


def address(rng: random.Random, hard: bool) -> str:
    base = f"{rng.choice(['서울특별시', '부산광역시', '대구광역시'])} {rng.choice(['중구', '남구', '서구'])}"
    return f"{base} {rng.choice(['한빛로', '솔빛로'])} {rng.randint(1, 400)}, 새봄아파트 {rng.randint(101, 130)}동 {rng.randint(101, 2505)}호" if hard else f"{base} {rng.choice(['달빛동', '별빛동'])} {rng.randint(1, 900)}-{rng.randint(1, 90)}"


def driver_license(rng: random.Random, hard: bool) -> str:
    return (rng.choice([" ", ""]) if hard else "-").join([str(rng.choice(REGIONS)), digits(rng, 2), digits(rng, 6), digits(rng, 2)])


MAKERS = {f.__name__: f for f in (name, phone, email, rrn, address, card, biz_reg, passport, account, birth_date, driver_license)}


def wrong(digit: int, rng: random.Random) -> int:
    """Any other digit."""
    return (digit + rng.randint(1, 9)) % 10


def distractor(rng: random.Random) -> str:
    """A value that looks like personal data and is none: no detector may find anything in it."""
    front = f"{rng.randint(100, 999)}{rng.randint(10, 99)}{digits(rng, 4)}"
    forms = {
        "order number": lambda: f"ORD-{rng.randint(2024, 2026)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}-{rng.randint(1000, 9999)}",
        "business number with a wrong check digit": lambda: f"{front[:3]}-{front[3:5]}-{front[5:]}{wrong(business_check(front), rng)}",
        "zip code": lambda: str(rng.randint(10000, 63999)),
        "price": lambda: f"{rng.randint(1000, 999000):,}원",
        "date": lambda: f"{rng.randint(2020, 2026)}.{rng.randint(1, 12):02d}.{rng.randint(1, 28):02d}",
        "tracking number": lambda: f"{''.join(rng.choice('ABCEFGHK') for _ in range(2))}{rng.randint(100000000, 999999999)}KR",
        "phone of no area": lambda: f"0{rng.choice('0789')}-{rng.randint(1000, 9999)}-{digits(rng, 4)}",
        "registration number of no date": lambda: f"{digits(rng, 2)}{rng.randint(13, 19)}{rng.randint(32, 39)}-{rng.randint(1, 4)}{digits(rng, 6)}",
        "mention of a region": lambda: rng.choice(["강남구에서", "성남시로", "수원시로"]),
        # Nine digits from 02 on would be a phone number of Seoul.
        "passport of another length": lambda: re.sub("^(.)0", r"\g<1>1", rng.choice("MSROD") + digits(rng, rng.choice([7, 9]))),
        "account without a cue": lambda: f"{digits(rng, 3)}-{digits(rng, 2)}-{digits(rng, 6)}",
        "licence of no region": lambda: f"{rng.choice(['05', '27', '29', '77'])}-{digits(rng, 2)}-{digits(rng, 6)}-{digits(rng, 2)}",
    }
    return forms[rng.choice(list(forms))]()


# ---- documents ------------------------------------------------------------------------------------------------------
POSITIVE = (
    "고객 {name}님 번호는 {phone} 확인|메일 {email} 접수|주민번호는 {rrn} 등록|배송지는 {address} 입니다|결제 카드 {card} 승인|사업자 {biz_reg} 확인|여권 {passport} 조회|급여는 국민은행 {account} 지급|"
    "생년월일은 {birth_date} 기재|면허 {driver_license} 갱신|환자 {name}님 메일 {email} 접수|코드 {distractor} 고객 {name}님 방문|자택 {phone} 그리고 직장 {phone} 등록|사업자 {biz_reg} 문의 {email} 접수"
).split("|")
PLAIN = "내일 오후 두 시 모임|이번 분기 목표는 두 배|코드 {distractor} 접수|값 {distractor} 그리고 {distractor} 확인|새벽 점검 예정".split("|")


def render(template: str, rng: random.Random, hard: bool, at: int = 0) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with its values, and (kind, start, end) of those that are personal data, ``at`` being its own start."""
    parts, labels = [], []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{"):
            kind, piece = piece[1:-1], distractor(rng) if piece == "{distractor}" else MAKERS[piece[1:-1]](rng, hard)
            if kind in MAKERS:
                labels.append((kind, at, at + len(piece)))
        parts.append(piece)
        at += len(piece)
    return "".join(parts), labels


def document(seed: int, number: int, negative: float = NEGATIVE, multi: float = MULTI) -> tuple[str, list[tuple[str, int, int]], str]:
    """Text, labels and difficulty of one document; several sentences are joined by one blank each."""
    rng = random.Random(f"{seed}:{number}")
    if rng.random() < negative:
        return (*render(rng.choice(PLAIN), rng, False), "negative")
    hard = rng.random() < 0.5
    text, labels = "", []
    for k in range(rng.choice([2, 3]) if rng.random() < multi else 1):
        text += " " if k else ""
        sentence, found = render(rng.choice(POSITIVE), rng, hard, len(text))
        text, labels = text + sentence, labels + found
    return text, labels, "hard" if hard else "easy"


def batch_of(numbers: list[int], seed: int, negative: float, multi: float) -> pa.RecordBatch:
    made = [document(seed, n, negative, multi) for n in numbers]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    labels = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in found] for _, found, _ in made], kind)
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([t for t, _, _ in made], pa.string()), labels, pa.array([d for *_, d in made], pa.string())], ["doc_id", "text", "labels", "difficulty"])


def for_keys(keys: DataFrame, key: str, seed: int = 42, negative: float = NEGATIVE, multi: float = MULTI) -> DataFrame:
    """A document for every key of a table (``doc_id``); the same as the source makes under that number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(batch.column("doc_id").to_pylist(), seed, negative, multi)

    return keys.select(F.col(key).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").mapInArrow(run, SCHEMA)


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.count, self.seed = int(options.get("count", 200)), int(options.get("seed", 42))
        self.negative, self.multi = float(options.get("negative", NEGATIVE)), float(options.get("multi", MULTI))
        self.parts = int(options.get("partitions", 0)) or max(1, -(-self.count // 100_000))
        if self.count < 0 or not (0 <= self.negative <= 1 and 0 <= self.multi <= 1):
            raise ValueError("count is 0 or more, negative and multi lie between 0 and 1")

    def partitions(self) -> list[InputPartition]:
        return [Range(self.count * i // self.parts, self.count * (i + 1) // self.parts) for i in range(self.parts)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for low in range(partition.low, partition.high, 5_000):
            yield batch_of(list(range(low, min(low + 5_000, partition.high))), self.seed, self.negative, self.multi)


class CorpusSource(DataSource):
    """Options: ``count`` (200), ``seed`` (42), ``negative`` (0.25), ``multi`` (0.15, of the rest), ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "mossveil_corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CorpusReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CorpusSource)
