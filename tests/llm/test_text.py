"""Pure functions of the training-data operators."""

import random
from collections import Counter

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkloom.llm import columns, confusions, leaks, lookalike, mojibake, pageparts, quality, scans, split, tokens, toxicity


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


ENCODER = None


def encoder():
    global ENCODER
    ENCODER = ENCODER or tokens.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return ENCODER


@pytest.mark.parametrize("text", ["", "a  b\n\n c\t\td \n x ", "<|endoftext|> hi", "\x1c a\x1fb", "   ", "\n", "　x y", "it's WE'LL n't", "é ​y", "a\u0085b\xa0c", "日本語", "🙂" * 9, "x" * 5000, " \n x", "Straße 12,5"])
def test_ids_equal_the_library(tokenizer, text):
    assert encoder().encode([text]) == [tokenizer.encode(text, add_special_tokens=False).ids]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_of_any_text(text):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json")) if not hasattr(test_ids_of_any_text, "t") else test_ids_of_any_text.t
    t.encode_special_tokens = True
    test_ids_of_any_text.t = t
    assert encoder().encode([text, None]) == [t.encode(text, add_special_tokens=False).ids, []]


def test_memory_of_stretches_is_bounded(monkeypatch, tokenizer):
    e = tokens.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = [f"word{i} " + "long" * 40 + f"{i} 日本語日本語" for i in range(50)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert e.encode(texts) == want and e.encode(texts) == want and not any(len(s) > tokens.LONG_STRETCH for s in e.known)
    monkeypatch.setattr(tokens, "MEMORY_BYTES", 100)
    assert e.encode(texts[:3]) == want[:3] and len(e.known) < 20


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é.\n日", min_size=0, max_size=900), st.integers(40, 120))
def test_pieces_cover_the_text(text, limit):
    ps = list(split.pieces_of(text, limit, 12, 60))
    assert "".join(text[c:e] for _, c, e in ps) == text
    for b, c, e in ps:
        assert len(text[b:e].encode()) <= limit and len(text[b:c].encode()) <= 12
    assert (len(ps) > 1) == (len(text.encode()) > limit)


def test_pieces_end_at_blocks_and_topics():
    a = "The cat sat on the mat and the cat purred. " * 16
    b = "Markets fell as bond prices rose in trading. " * 9
    text = a.strip() + "\n\n" + b.strip() + "\n\n" + b.strip()
    first = next(split.pieces_of(text, 1200, 50))
    assert text[: first[2]].endswith("\n\n") and "Markets" not in text[: first[2]]
    with pytest.raises(ValueError):
        list(split.pieces_of("x" * 50, 20, 15))


def test_mojibake_round_trip():
    texts = {"de": "Die Brücken wurden über Nacht erhöht, größer als gestern.", "fr": "Les élèves ont été déplacés à midi, où l'on s'étonne.", "ru": "Наши рынки уже открыты, но поезда ещё ждут.", "ja": "新しい駅は昨日開かれた。"}
    pairs = [("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("fr", "utf-8", "mac_roman"), ("de", "utf-8", "cp437"), ("de", "cp1252", "cp437"), ("fr", "mac_roman", "cp1252"), ("ja", "utf-8", "cp1252")]
    for lang, true, used in pairs:
        raw = texts[lang].encode(true)
        bad = "".join(mojibake.from_byte(used).get(x, chr(x)) if x > 127 else chr(x) for x in raw)
        text = f"A sound line.\n{bad}\nEin schöner Satz.\n"
        assert mojibake.is_garbled(text), (lang, true, used)
        fixed = mojibake.restore(text)
        assert "Ein schöner Satz." in fixed and "A sound line." in fixed
        assert fixed.split("\n")[1] == texts[lang], (lang, true, used, fixed)
    twice = texts["de"].encode().decode("cp1252", "replace").encode().decode("cp1252", "replace")
    assert mojibake.is_garbled(twice)
    for t in (*texts.values(), None, "", "IRMÃS e MAÇÃS", "ia la foule ; l’été était là", "240 m² and ½", "coil of 12 Ω", "été créée", "местныe дороги"):
        assert not mojibake.is_garbled(t), t
    assert mojibake.is_garbled("The word ��� was") and mojibake.restore("a �") == "a �"


@pytest.mark.parametrize("used", [*mojibake.SINGLE, *mojibake.DOUBLE])
def test_utf8_read_by_any_charset(used):
    """Every pair: found, and restored where the charset has read all bytes; sound lines beside it stay."""
    texts = ["Les élèves ont été déplacés à midi.", "Наши рынки уже открыты.", "新しい駅は昨日開かれたと言う。", "Zażółć gęślą jaźń."]
    for text in texts:
        raw = text.encode()
        if used in mojibake.SINGLE:
            bad = "".join(mojibake.from_byte(used).get(x, chr(x)) if x > 127 else chr(x) for x in raw)
        else:
            bad = raw.decode(used, "replace")
        page = f"A sound line.\n{bad}\nEin schöner Satz.\n"
        if "\ufffd" not in bad:
            assert mojibake.restore(page) == page.replace(bad, text), (used, bad)
        assert mojibake.is_garbled(page), (used, bad)
    for sound in ("新しい駅は昨日開かれた。ＡＢＣ、カタカナ", "这是一个中文的文本文件，在人民的国家。", "한국어 문장입니다. 안녕하세요", "「東京」とTokyoと大阪", "a漢字b", "茅葺き屋根の家", "中国China和日本Japan"):
        assert not mojibake.is_garbled(sound), sound


@pytest.mark.parametrize("true", ["utf-16-le", "utf-16-be", "utf-16", "utf-32-le", "utf-32-be", "utf-7", "iso2022_jp", "hz"])
def test_garbled_to_ascii(true):
    """UTF-16 and UTF-32 read byte by byte and seven-bit charsets read as any other, in part of a text and as a whole."""
    texts = {"iso2022_jp": ["# 新しい駅は昨日\n\n開かれた。"], "hz": ["这是一个中文的文本。"]}.get(true, ["The market was closed.\nYes.", "Les élèves, à midi, où l’on s’étonne…", "Наши рынки уже открыты.", "Zażółć gęślą jaźń 😀 tak."])
    if true != "utf-7":
        texts = [*texts, "# 新しい駅は昨日\n\n開かれた。"] if true.startswith("utf") else texts
    for text in texts:
        bad = "".join(mojibake.from_byte("cp1252").get(x, chr(x)) if x > 127 else chr(x) for x in text.encode(true))
        if bad == text:  # UTF-7 leaves ASCII as it is
            continue
        for page in (bad, f"A sound line.\n{bad}\nEin schöner Satz.\n"):
            assert mojibake.is_garbled(page), (true, page)
            assert mojibake.restore(page) == page.replace(bad, text), (true, page)


def test_sound_ascii():
    assert mojibake.is_garbled("\x1b$B?7") and mojibake.restore("a $B?7$7$$1X$O(B b") == "a 新しい駅は b"
    for t in ("a\0b", "PK\x03\x04\0\0\0\0\x08", "~{name~} ~{~a~}", "C+API and A4+A3, Pros+Yes, +IBM, Python+API-first", "+49 123 4567+89", "$A$B$C$D", "$Bash (B", "\x1b[31mred\x1b[0m", "Zm9v+AOk" * 9, "1+ABC-2"):
        assert not mojibake.is_garbled(t) and mojibake.restore(t) == t, t
    assert mojibake.is_garbled("$B" * 40_000) is False


def test_declared_charset_decides():
    assert mojibake.charset_named("ISO-8859-5") == "iso8859-5" and mojibake.charset_named("no such") is None and mojibake.charset_named(None) is None
    assert mojibake._single_byte_pair(["Stra\u00e1e"], "cp850")[1] == "cp850"


SCORES = lookalike.Scores(Counter(zip("thequickbrownfoxpaidtheratesshould" * 3, "hequickbrownfoxpaidtheratesshouldt" * 3)))


def test_lookalikes():
    c = lambda t: lookalike.canonical(t, SCORES)
    for bad, good in (("ｒates", "rates"), ("café", "café"), ("o​ne", "one"), ("a b", "a b"), ("oﬃce", "office"), ("shоuld", "should"), ("стаpые", "старые"), ("Key", "Key"), ("much‑needed", "much-needed"), ("ｷﾞ", "ギ"), ("for іѕ it", "for is it")):
        assert c(bad) == good, bad
    for same in ("m² ½ 2.º", "“q” – ‘r’ — …", "café über", "the word «пекарня» was", "coil of 12 Ω", "word σκηνη here", "日本語、ア", "", None, "BΣcker"):
        assert c(same) == same, same
    assert c(c("shоuld ｒates")) == c("shоuld ｒates")


PAGE = """Skip to main content

[Site Name](/)

* [News](/news)
* [Sport](/sport)

# A Headline

By A. Writer

The first paragraph of the article is long enough to be prose and it ends here.

ADVERT

- a point of the article, which is a sentence.
- another one.

More from us: [Other piece](/123)

The last paragraph of the article also is long enough to be prose, as it must be.

## Most read

* [One](/1)
* [Two](/2)

© 2020 Site Name. All rights reserved.
"""


def test_page_lines():
    lines = pageparts.page_lines(PAGE, ("site", "name"), "A Headline | Site Name")
    sure = {x.text for x in lines if x.verdict == 1}
    assert {"Skip to main content", "[Site Name](/)", "* [News](/news)", "ADVERT", "More from us: [Other piece](/123)", "## Most read", "* [One](/1)", "© 2020 Site Name. All rights reserved."} <= sure
    assert not any(x.startswith(("# A", "The ", "By", "- a")) for x in sure)
    assert pageparts.headline(lines) == "A Headline"
    assert pageparts.title_has_more("A Headline | Site Name", "A Headline", ("site", "name")) and not pageparts.title_has_more("A Headline", "A Headline") and not pageparts.title_has_more(None, "x")
    assert pageparts.page_lines("", ()) == []


def test_text_classes():
    k = lambda t, conv="plaintext": quality.text_class(t, conv, set())
    prose = "The bakers of the town have recovered, and the statue will be repaired soon. Nobody was hurt by it.\n\n" * 3
    assert k(prose) is None and k(prose.upper()) is None
    assert k("\n".join(f"* item number {i}" for i in range(9))) == "list"
    assert k("\n".join(f"{a}. Brown{a}" for a in "ABCDEFGH")) == "list"
    assert k("| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * 9) == "table"
    assert k("\n".join(f"{i}\tname{i}\t{i * 3}" for i in range(9))) == "table"
    assert k("\n".join(f"{'x' * (i % 4 + 1):<8}{i:<6}place" for i in range(9))) == "table"
    r = random.Random(1)
    assert k("\n".join("".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(76)) for _ in range(9))) == "junk"
    assert k("- - - - - - -\n|||||||||||\n........\n" * 6) == "junk" and k("test test test test test test\n" * 20) == "junk"
    assert k("".join(f"A: Good day to you, sir, said man {n}.\nB: And {n} to you as well, said the other.\n" for n in range(4))) is None
    assert k(None) is None and k("") is None and k(" \n") is None
    assert quality.statistics(None, set()) == (None,) * len(quality.STATS) and quality.statistics("", set())[0] == 0
    assert quality.statistics("The cat. The dog.", {"the"})[4] == 0.5


def test_reading_order():
    text = "HEAD\nleft one\nright one\nleft two\nright two"
    x0, x1, y0 = [100, 100, 640, 100, 640], [400, 600, 1140, 600, 1140], [10, 50, 50, 90, 90]
    assert columns.reading_order(text, x0, x1, y0, 2) == ["HEAD", "left one", "left two", "right one", "right two"]
    merged = columns.reading_order("HEAD\nleft aaaa one | right one\nleft aaaa two\nright two", [100, 100, 100, 640], [400, 1140, 600, 1140], [10, 50, 90, 90], 2)
    assert columns.running_text(merged) == "HEAD left aaaa one left aaaa two right one right two"
    assert columns.reading_order("a\nb", None, None, None, None) == ["a", "b"]
    assert columns.running_text(["a wo-", "rd", "|||", "", "end"]) == "a word end"


def test_cgk_finds_what_brute_force_finds():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abdeghijkmnprtuvwz") for _ in range(r.randint(3, 9))) for _ in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(36))) for i in range(30)]
    index = leaks.ItemIndex(items)
    hit = tried = 0
    for i, text in items:
        words = text.split()
        for _ in range(6):
            at = r.randint(0, 14)
            part = " ".join(words[at : at + 22])
            noisy = "".join("q" if ch != " " and r.random() < 0.02 else ch for ch in part)
            doc = " ".join(r.choice(vocabulary) for _ in range(60)) + " " + noisy + " " + " ".join(r.choice(vocabulary) for _ in range(60))
            folded = confusions.skeleton(doc)
            symbols = leaks._encode(folded + " " * (leaks.STEPS + 2))
            starts = leaks._word_starts(symbols)[:: leaks.STRIDE]
            found = {item for _, item in index.candidates(leaks.window_keys(symbols, starts))}
            tried += 1
            hit += i in found
    assert hit >= 0.9 * tried, (hit, tried)


def test_runs():
    own = [f"w{i}word" for i in range(30)]
    other = [f"o{i}ther" for i in range(50)]
    assert leaks.best_run(own, other[:20] + own[5:22] + other[20:]) == 17
    assert leaks.chained_run(own, other[:9] + own[:10] + other[9:30] + own[10:20] + other[30:])[0] == 20  # an insertion of 21 words
    pattern = [w if i % 4 else f"x{i}xx" for i, w in enumerate(own)]
    assert leaks.best_run(own, pattern) < 15
    assert leaks._near("drawing", "drawimg") and not leaks._near("cat", "dog")


def test_scan_furniture():
    head = "The Long Title of a Thing"
    pages = [f"{head}, March.\n\n{['The first sentence goes on over', 'A quite different matter fills'][n // 2]} the end of\n\np. {n}" if n % 2 else f"{['more of the text is on this page', 'nothing was said there of his tale'][n // 4]} and it\n\nCopy 7. Not to be taken away.\n\np. {n}" for n in range(1, 5)]
    md = "\n\n".join(f"<!-- tool: page {n} includes OCR text -->\n\n{p}" for n, p in enumerate(pages, 1)) + "\n"
    rec = scans.Record(md, None, None, None)
    kinds = {rec.lines[i]: k for i, k in rec.found.items()}
    assert kinds[f"{head}, March."] == "header" and kinds["Copy 7. Not to be taken away."] == "header" and kinds["p. 3"] == "page_no"
    assert len([k for k in kinds if not k.startswith(("p.", head, "Copy"))]) == 0
    assert confusions.anagram_hash("listen") == confusions.anagram_hash("silent") and confusions.skeleton("rnodern br0ad") == confusions.skeleton("modern broad")


def test_toxicity_model():
    r = random.Random(5)
    filler = ["The market opens on Monday near the old bridge.", "Rain fell on the town before noon today.", "A prize was given to the best of the gardeners.", "The council met and the roof was repaired."]
    bad = ["You are a worthless swine and a brute.", "Shut your mouth, you worthless brute.", "Go to hell, you filthy swine."]
    trap = ["The swine of the farmer were sold on Friday.", "He was fined for having shouted abuse."]
    page = lambda extra: toxicity.windows(" ".join(r.sample(filler * 3, 8) + extra))
    pos = [page([r.choice(bad)]) for _ in range(60)]
    neg = [page([r.choice(trap)]) for _ in range(60)]
    unl = [page([r.choice(trap)] if i % 3 == 0 else []) for i in range(300)]
    on_all = toxicity.page_counts(pos[:9] + neg + unl)
    model = toxicity.fit_pages(pos, neg, on_all, 9 + len(neg) + len(unl))
    assert sum(model.page(t) >= model.threshold for t in pos) >= 55
    assert sum(model.page(t) >= model.threshold for t in neg) <= 3
    assert model.page([]) == toxicity.NO_CASE and model.score(["market"]) == model.bias < model.threshold
    assert toxicity.fit_pages([], neg, on_all, 400) is None
    assert toxicity.best_threshold([(3.0, True), (1.0, False)]) == 2.0


def test_toxicity_windows_keep_short_and_spelt_words():
    fold = lambda t: confusions.skeleton(t).split()
    assert toxicity.windows("He met the d.i.c.k.h.e.a.d. on the road.") == [[*fold("He met the dickhead"), "*"], fold("on the road")]
    assert toxicity.windows("You f.u.c.k.i.n.g bitch, go away.") == [[*fold("You fucking bitch go away"), "*"]]
    assert toxicity.windows("b.a.s.t.a.r.d.") == [[*fold("bastard"), "*"]] and toxicity.windows("Idiot!") == [fold("Idiot")]
    assert toxicity.windows("Swine! You are a fool. Pig!") == [fold("Swine You are a fool Pig")]
    assert toxicity.windows("They sold the U.S.A. wares of it.")[0] == fold("They sold the USA")
    assert toxicity.windows("") == toxicity.windows(" ... ") == []


def test_text_classes_by_rhythm():
    common = set("the of and a to in is was it for with his on that as at by he had not are but from".split())
    k = lambda t: quality.text_class(t, "plaintext", common)
    entries = [("Galvanised steel brackets, assorted heavy warehouse fittings and fixings", "crate forty, upper shelving, northern aisle, brass handles and loose pegs"), ("Seasoned larch planking, rough sawn timber, nineteen bundles, tarred ends", "yard seven, beneath canvas, eastern wall, marked red chalk, weighed twice")] * 3
    indented = "\n".join(f"{a} {i}\n    {b} {i}" for i, (a, b) in enumerate(entries))
    assert quality._indentation_period(indented.split("\n")) == 1.0 and quality._indentation_period(["a", "b", "c", "d"]) == 0.0
    assert k(indented) == "list"
    rhythm = "\n".join(f"{a}, {b} {i}\nlot {i} sold" for i, (a, b) in enumerate(entries))
    assert k(rhythm) == "list"
    verse = "\n".join(f"The wind was on the water and it had a voice of gold {i}\n    and he that heard it by the shore was not a man to hold" for i in range(6))
    assert k(verse) is None


def test_filling_text_is_of_no_language():
    common = quality.CommonWords({"en": set("the of and a to in is was it for with his on that as at by he had not are but from".split()), "fr": set("le la les de des et à un une en est que qui dans pour sur pas au il".split())})
    filling = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur."
    assert quality.text_class(filling, "plaintext", common) == "junk" and quality.text_class(filling, "plaintext", set()) is None
    prose = "The bakers of the town have recovered, and the statue was repaired for the fair. Nobody was hurt by it, but a cart in the yard is lost to his firm. He had not asked for it at all."
    assert quality.text_class(prose, "plaintext", common) is None
    russian = "Наши рынки уже открыты, но поезда ещё ждут. " * 6
    assert quality.text_class(russian, "plaintext", quality.CommonWords({"ru": {"но", "уже", "ещё"}})) is None


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=10), st.data())
def test_near_words_share_an_end(word, data):
    at = data.draw(st.integers(0, len(word)))
    cut = data.draw(st.integers(0, 2))
    other = word[:at] + data.draw(st.text("abcx", max_size=2)) + word[at + cut :]
    if leaks._near(word, other):
        known = leaks.ItemWords([[word]])
        assert leaks.may_match(known.items[0], set(known.of(other)), 1)
