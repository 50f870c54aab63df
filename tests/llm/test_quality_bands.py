"""The whole verdict of the quality rules: band edges by script, public texts inside, junk outside, brute force."""

import base64
import math
import random
import unicodedata
from collections import Counter

import pytest
import sentencepiece

from routeloom.llm import common, quality, queries
from routeloom.llm.license_texts import TEXTS

PIECE = common.vocabulary(queries.PIECE_VOCABULARY)
#: The first article of the Universal Declaration of Human Rights (public text).
ARTICLE = {
    "LATIN": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "CYRILLIC": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "GREEK": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "ARABIC": "يولد جميع الناس أحرارًا متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميرًا وعليهم أن يعامل بعضهم بعضًا بروح الإخاء.",
    "HEBREW": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
    "CJK": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "HIRAGANA": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "HANGUL": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "DEVANAGARI": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "THAI": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ",
}


def measured(text):
    n, chars, *_, pieces, main, _, _, fallback, bits, _ = quality.judge(text, quality.fertility(PIECE))
    letters = round(quality.judge(text, quality.fertility(PIECE))[10] * pieces)
    return main, n, chars, letters, pieces, fallback, bits


def brute(text):
    """(reason, measures) straight from the library, letter by letter."""
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    words = (text or "").encode().split()
    if len(words) < 10:
        return "too short"
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    if 100 * len({i + j for i, x in enumerate(windows) if many[x] > 1 for j in range(5)}) > 20 * len(words):
        return "repeats itself"
    ids = [i for w in words for i in model.encode(w.decode())]
    scripts = Counter()
    for c in text:
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0].split("-")[0]
            scripts[name if name in quality.BANDS else "other"] += 1
    main = min(scripts, key=lambda k: (-scripts[k], k), default="")
    band, chars = quality.BANDS[main], sum(len(w.decode()) for w in words)
    if sum(scripts.values()) < band.least * len(ids):
        return "few letters a token"
    if chars > band.most * len(ids):
        return "many characters a token"
    if sum(map(model.is_byte, ids)) > band.fallback * len(ids):
        return "byte fallback"
    bits = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
    return "low entropy" if len(words) >= band.long and bits < band.bits else None


@pytest.mark.parametrize("name", sorted(ARTICLE))
def test_public_texts_lie_well_inside_their_band(name):
    main, n, chars, letters, pieces, fallback, bits = measured(ARTICLE[name])
    band = quality.BANDS[name]
    assert main == name and quality.verdict(main, n, chars, letters, pieces, fallback, bits) is None
    assert 1.5 * band.least * pieces <= letters and chars * 1.2 <= band.most * pieces and fallback <= band.fallback


@pytest.mark.parametrize("name", sorted(quality.BANDS))
def test_edges(name):
    band, many = quality.BANDS[name], 1000
    at = lambda letters=3 * many, chars=int(band.most * many), fallback=band.fallback, bits=band.bits, n=50: quality.verdict(name, n, chars, letters, many, fallback, bits)
    assert at(letters=math.ceil(band.least * many)) is None and at(letters=math.ceil(band.least * many) - 1) == "few letters a token"
    assert at(chars=int(band.most * many) + 1) == "many characters a token"
    assert at(fallback=band.fallback + 1e-9) == "byte fallback"
    assert at(bits=band.bits - 1e-9) == "low entropy" and at(bits=0.0, n=49) is None


def junk():
    r = random.Random(4)
    of = lambda make, n=80: " ".join(make() for _ in range(n))
    yield "few letters a token", of(lambda: r.randbytes(16).hex())
    yield "few letters a token", of(lambda: base64.b64encode(r.randbytes(24)).decode())
    yield "few letters a token", of(lambda: f"{r.choice(['the', 'of', 'and', 'tion', 'er'])}{r.choice('#$%&*') * 3}")
    yield "few letters a token", "\n".join(of(lambda: r.choice(["dÃ©jÃ", "vÃ¼", "cÃ´tÃ©", "franÃ§ais", "Ã¨re"]), 9) + str(i) for i in range(9))
    yield "many characters a token", of(lambda: "=" * (16 * r.randrange(1, 6)) + " " + r.choice("information development communication international government".split()), 60)
    yield "low entropy", of(lambda: r.choice(["one", "two", "three", "four"]), 60)


@pytest.mark.parametrize(("reason", "text"), list(junk()))
def test_junk_is_rejected(reason, text):
    assert brute(text) == reason


@pytest.mark.parametrize("text", [None, "", "word " * 5, *ARTICLE.values(), *[t for _, t in junk()], *list(TEXTS.values())[:3]])
def test_verdict_against_brute_force(text):
    assert quality.judge(text, quality.fertility(PIECE))[-1] == brute(text)


def test_bands_decide(spark):
    """Every document's verdict by brute force; the bands reject some of them beyond the base rule."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["reason"] for r in quality.quality(docs, PIECE).collect()}
    want = {r["doc_id"]: brute(r["text"]) for r in docs.select("doc_id", "text").collect()}
    assert got == want and "few letters a token" in set(got.values())


def test_measures_do_not_depend_on_repeats_order_or_the_memo():
    m = quality.Fertility(common.vocabulary("piece_bpe_32k.model"))
    for text in ["the cat the dog", "naïve Ωmega naïve 12 дом дом", "\U0001f600 a1 中文字 中文字 #", "x", ""]:
        words = text.encode().split()
        pieces = [i for w in words for i in m.model.encode(w.decode())]
        letters = [k for k in map(quality.script, text) if k]
        total, n, main, low, bits = m.measure(Counter(words))
        counts = Counter(pieces)
        assert (total, n) == (len(pieces), len(letters)) and main == max(sorted(set(letters)), key=letters.count, default="")
        assert low == (sum(map(m.model.is_byte, pieces)) / total if total else 0.0)
        assert bits == pytest.approx(-sum(c / total * math.log2(c / total) for c in counts.values()) if total else 0.0, abs=1e-12)
        assert m.measure(Counter(words[::-1])) == (total, n, main, low, bits)
