"""Text functions as column expressions: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = "[\\s\\u00A0\\u3000,，。、;；：:？?！!（）()【】\\[\\]\"'《》<>/\\-—|·•]+"


def words(text: Column) -> Column:
    """Lower-case letter runs, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def han_tokens(text: Column) -> Column:
    """Of each segment: itself if 2 to 4 Han characters, then its Han bigrams, then its Han trigrams; repeats kept."""

    def grams(s: Column, n: int) -> Column:
        at = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(at, lambda i: F.substring(s, i, n)), lambda g: g.rlike(f"^[\\u4e00-\\u9fa5]{{{n}}}$"))

    def of(s: Column) -> Column:
        whole = F.when(s.rlike("^[\\u4e00-\\u9fa5]{2,4}$"), F.array(s)).otherwise(F.array().cast("array<string>"))
        return F.concat(whole, grams(s, 2), grams(s, 3))

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), SEGMENT), of))


def two_places(x: Column) -> Column:
    """Half-up rounding on doubles, the same in any engine."""
    return F.floor(x * 100 + 0.5) / 100


def four_places(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def bare(text: Column) -> Column:
    """Without white space at the ends; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


#: An absolute address: host, path, fragment.
ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)(?:\?[^#]*)?(#.*)?$"


def site_of(url: Column, sites: dict[str, tuple[str, ...]], other: str) -> Column:
    """The first site one of whose marks is in the host of url (a mark that starts with `=` must be the whole host)."""
    host = F.lower(F.regexp_extract(url, ADDRESS, 1))
    out = F.lit(other)
    for site, marks in reversed(sites.items()):
        found = [host == m[1:] if m.startswith("=") else host.contains(m) for m in marks]
        out = F.when(F.array_contains(F.array(*found), True), site).otherwise(out)
    return out


def short_page(page: Column) -> Column:
    """What tells a page: its fragment, or else its path; empty for a start page or what is neither."""
    p = bare(page)
    whole = p.rlike(ADDRESS)
    fragment = F.when(whole, F.regexp_extract(p, ADDRESS, 3)).when(p.startswith("#"), p).otherwise("")
    path = F.when(whole, F.regexp_extract(p, ADDRESS, 2)).when(p.startswith("/"), p).otherwise("")
    return F.when(~fragment.isin("", "#", "#/"), fragment).when(whole & (path == "/"), "").otherwise(path)


def is_structural(text: Column, marks: str, bars: int = 12) -> Column:
    """Tables of contents and charts: a vocabulary (a pattern), or as many bars. Null is neither."""
    return F.coalesce(text.rlike(marks) | (F.regexp_count(text, F.lit("[|]")) >= bars), F.lit(False))


def clean_path(path: Column) -> Column:
    """Trimmed, 200 characters at most, with a leading slash."""
    p = F.substring(F.trim(F.coalesce(path, F.lit("/"))), 1, 200)
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


#: Fixed patterns of personal data; (?U) gives \d and \s their Unicode meaning. What may not touch an address is a letter or number
#: of any kind (½ and circled ones too), not the marks and joiners that a Unicode \w holds.
PRIVATE = {
    "mobile": r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)",
    "id_card": r"(?U)(?<!\d)(?:\d{17}[0-9Xx]|\d{15})(?!\d)",
    "email": r"(?<![\p{L}\p{N}_.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\p{L}\p{N}_.-])",
    "name_label": r"(?U)(患者|病人|患名|姓名|名字|家属|联系人|就诊人|主诉人|主诉患者|首诊患者)[：:\s]+([一-龥]{2,4})",
    "medical_record": r"(?U)(病历号|住院号|门诊号|档案号|病案号|就诊号|保健号|医保号|社保号|卡号)[：:\s]*([A-Za-z0-9\-]{4,30})",
    "address_full": r"(?U)(?:(?:北京|上海|天津|重庆)(?:市)?[一-龥]{0,10}(?:区|县)|[一-龥]{2,6}(?:省|自治区|特别行政区)[一-龥]{1,10}(?:市|地区|盟|自治州)[一-龥]{0,10}(?:区|县|旗|市)?)[一-龥]{0,30}(?:路|街|巷|弄|村|镇|乡|大道|大街)[一-龥\d]{0,20}(?:号|室|楼|栋|单元)?[\d\-]*",
    "address_label": r"(?U)(地址|住址|家庭住址|现住址|联系地址|通讯地址|居住地)[：:\s]+([^\n，。；！？,;:!?一-龥]{0,5}[一-龥\d]{4,80})",
}
#: Paths of a home folder, and what of one is made relative: a path with something after the user's name.
HOME = r"""(?U)/(?:Users|home)/[^\s\]\[()<>"'，。；：、]+(?:/[^\s\]\[()<>"'，。；：、]+)*"""
RELATIVE = r"""(?U)/(?:Users|home)/[^\s/\]\[()<>"'，。；：、]+/%s([^\s\]\[()<>"'，。；：、]*)"""
#: Counted, never masked.
SCANNED = PRIVATE | {"local_path": HOME, "institution": "[一-龥]{2,15}(?:医院|卫生院|门诊部|诊所|中医馆|国医馆|医馆|疗养院|康复中心)"}
#: Changed, and counted then.
CHANGED = (*PRIVATE, "local_path", "wikilink")
#: Of what is scanned, what alone doesn't block a corpus.
MEDIUM = ("name_label", "institution")
MASK = {"mobile": "[已脱敏手机号]", "id_card": "[已脱敏身份证号]", "email": "[已脱敏邮箱]", "name_label": "$1：[已脱敏姓名]", "medical_record": "$1：[已脱敏病历号]", "address_full": "[已脱敏地址]", "address_label": "$1：[已脱敏地址]"}


def redacted(text: Column, patterns: dict[str, str] = PRIVATE) -> Column:
    """Personal data masked, patterns in order, then line ends made uniform."""
    for name, pattern in patterns.items():
        text = F.regexp_replace(text, pattern, MASK[name])
    return F.regexp_replace(text, "\r\n?", "\n")


def private_counts(text: Column, patterns: dict[str, str] = SCANNED) -> Column:
    """Matches by pattern, earlier masks left out."""
    bare = F.regexp_replace(text, r"\[已脱敏[^\]]*\]", "")
    return F.create_map(*(x for name, p in patterns.items() for x in (F.lit(name), F.regexp_count(bare, F.lit(p)))))


#: A link, its inside as a group, up to the first closing pair of its line; and an opener left over.
LINK = r"(?Ud)!?\[\s*\[\s*(.*?)\s*\]\s*\]"
OPENER = r"(?U)(!?)\[\s*\["


def link_text(inner: Column) -> Column:
    """What stands for a link: its alias, or its title (the file's name) and heading."""
    target, heading = bare(F.substring_index(inner, "#", 1)), bare(F.regexp_extract(inner, "(?s)^[^#]*#(.*)$", 1))
    file = F.coalesce(F.try_element_at(F.filter(F.split(target, "/"), lambda x: ~x.isin("", ".")), F.lit(-1)), F.lit(""))
    title = F.regexp_replace(file, r"(?i)\.md\z", "")
    named = F.when(heading == "", F.when(title == "", inner).otherwise(title)).when(title == "", heading).otherwise(F.concat(title, F.lit(" · "), heading))
    return F.when(F.contains(inner, F.lit("|")), bare(F.substring_index(inner, "|", -1))).otherwise(named)


def _relative(text: Column, roots: tuple[str, ...]) -> Column:
    lead = "(?:" + "|".join(rf"\Q{root}\E" for root in roots) + ")?" if roots else ""
    return F.regexp_replace(text, RELATIVE % lead, "$1")


def linked(text: Column) -> Column:
    """text with its links readable."""
    inner = F.regexp_extract_all(text, F.lit(LINK), 1)
    between = F.transform(F.split(text, LINK, -1), lambda part, i: F.concat(part, F.coalesce(link_text(bare(F.get(inner, i))), F.lit(""))))
    return F.when(F.contains(text, F.lit("[")), F.array_join(between, "")).otherwise(text)


def sanitised(text: Column, roots: tuple[str, ...] = (), patterns: dict[str, str] = PRIVATE) -> Column:
    """Text for publishing: home paths made relative (to the first of roots that leads them), links readable, personal data masked.

    A home folder itself stays, and is found by private_counts: a corpus that holds one is blocked.
    """
    text = F.regexp_replace(linked(_relative(text, roots)), OPENER, "$1[")
    text = F.replace(F.replace(text, F.lit("[["), F.lit("[")), F.lit("]]"), F.lit("]"))
    return redacted(text, patterns)


def transformations(text: Column, mail: str | None = None) -> Column:
    """What sanitised would change, by pattern, counted before any of it is changed; openers left over once links are readable
    count as links. mail stands in for the pattern of addresses."""
    patterns = PRIVATE | {"local_path": HOME, "wikilink": LINK} | ({"email": mail} if mail else {})
    left = F.regexp_count(linked(_relative(text, ())), F.lit(OPENER))
    count = lambda name, p: F.regexp_count(text, F.lit(p)) + (left if name == "wikilink" else 0)
    return F.create_map(*(x for name, p in patterns.items() for x in (F.lit(name), count(name, p))))


ITEM = r"(?:\d+\.|[-*]|>|#{1,6}\s)"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: blocks between blank lines; lines of lists, quotes and headings stand alone. Null has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^[^\S\n]+|[^\S\n]+$", "")
    marked = F.regexp_replace(trimmed, rf"(?m)^({ITEM}.*)$", "\x01$1\x01")
    return F.filter(F.split(marked, "\n*\x01\n*|\n{2,}|^\n|\n$"), lambda p: p != "")
