"""Rules that keep or drop a listing by its words, numbers, categories and price."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the extended cab, body styles for and against it, and words of parts and memorabilia.
TERMS = ["king cab", "kingcab", "king-cab", "extended cab", "キングキャブ", "คิงแค็บ", "คิงแคป", "คิงเเค็บ", "cabina y media"]
BODY_FOR = ["king", "extended", "extra cab", "xtracab"]
BODY_AGAINST = ["standard cab", "regular cab", "single cab", "crew cab", "double cab"]
PART_WORDS = [
    "for datsun", "fits datsun", "fit datsun", "carburetor", "carb ", "fender",
    "grille", "emblem", "badge", "decal", "sticker", "brochure", "manual",
    "toy", "diecast", "die-cast", "1/64", "1/24", "1:24", "1:64", "model kit",
    "keychain", "mug", "t-shirt", "shirt", "poster", "tail light", "taillight",
    "headlight", "bumper", "mirror", "door handle", "weatherstrip", "seal kit",
    "gasket", "bearing", "brake", "clutch", "radiator", "tailgate",
    "print ad", "advertisement", "magazine", "photo", "blueprint", "promo",
    "art", "man cave", "banner", "sign", "patch", "keyring", "tomica",
    "tomytec", "hot wheels", "matchbox", "1/43", "1:43", "greenlight",
]
AD_WORD = r"(?i)\bads?\b|\badvert\b"
VEHICLE_CATEGORIES = ["cars & trucks", "classic cars", "automobiles", "other vehicles", "pickup"]
# Fixed values, as they must match: the model's number, other generations, brands and words of trucks; whole vehicles'
# category in Japan; words of parts, toys and print there. [0-9], not \d: Java's \d and DuckDB's agree on it.
NUMBER = r"(?<![0-9A-Za-z])620(?![0-9])"
OTHER_GENERATION = r"(?i)(?<![0-9])(?:520|521|720)(?![0-9])|D2[12]"
OTHER_NUMBER = r"(?<![0-9])(520|521|720)(?![0-9])"
OTHER_WORDS = ["d21", "d22", "big m", "big-m", "navara", "frontier", "จูเนียร์"]
BRANDS = ["datsun", "ดัทสัน", "ดัทซัน", "ช้างเหยียบ"]
TRUCK = r"(?i)(?<![0-9A-Za-z])620(?![0-9])|(?<![0-9])(?:1300|1500)(?![0-9])|กระบะ|ช้างเหยียบ|truck|pickup|pick-up"
MODEL_NAME = "ダットサントラック"
WHOLE_VEHICLE = "中古車"
PART_WORDS_JP = [
    "用", "パーツ", "部品", "テールランプ", "ヘッドライト", "フェンダー", "グリル",
    "エンブレム", "バンパー", "マフラー", "ミラー", "カタログ", "ミニカー",
    "トミカ", "ステッカー", "キーホルダー", "シート", "ホイール", "キャブレター",
    "ブロックキット", "ローダウン", "リーフ", "サスペンション", "デカール",
    "ポスター", "雑誌", "広告", "プラモ", "模型", "ラジエーター", "ドアハンドル",
    "レンズ", "ガスケット", "ブレーキ", "クラッチ", "ワイパー", "ベアリング",
    "テールゲート", "ボンネット", "荷台", "メーター", "ウインカー", "ランプ",
    "ガラス", "モール", "ノベルティ", "パンフレット", "取扱説明書",
    "ホットウィール", "ホットウイール", "hot wheels", "ポップレース", "pop race",
    "jdm tuners", "ダイキャスト", "ルース", "未開封", "1/64", "1:64", "1/43",
    "1:43", "1/24", "1:24",
    "スパークプラグ", "プラグ", "イグニッション", "キーシリンダー", "スイッチ",
    "デスビ", "ローター", "コンデンサー", "ファンベルト", "ホース", "フィルター",
    "エアクリーナー", "点火",
]
FLOOR, AUCTION_FLOOR = 500, 100_000


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds any of the words, anywhere."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, words)), lambda w: t.contains(w))


def keywords(title: Column, description: Column, body: Column, terms: list[str] = TERMS, good: list[str] = BODY_FOR, bad: list[str] = BODY_AGAINST) -> Column:
    """matched, matched_terms (in the list's order) and what the body style says; a contrary style overrides the text."""
    text = F.lower(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(description, F.lit(""))))
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: text.contains(t))
    style = F.when(any_of(body, good), "pass").when(any_of(body, bad), "fail").otherwise("unavailable")
    return F.struct(((F.size(found) > 0) & (style != "fail")).alias("matched"), found.alias("matched_terms"), style.alias("body_style_check"))


def whole_number(text: Column, number: int = 620) -> Column:
    return text.rlike(rf"(?U)\b{number}\b")


def number_alone(text: Column) -> Column:
    """The model number, not within a longer number or code."""
    return text.rlike(NUMBER)


def other_generation(text: Column) -> Column:
    return text.rlike(OTHER_GENERATION)


def looks_like_part(title: Column, categories: Column | None = None) -> Column:
    part = any_of(title, PART_WORDS) | title.rlike(AD_WORD)
    if categories is None:
        return part
    vehicle = F.exists(categories, lambda c: any_of(c, VEHICLE_CATEGORIES))
    return part | ((F.size(categories) > 0) & ~vehicle)


def below_floor(amount: Column, options: Column, floor: float = FLOOR) -> Column:
    """A fixed price, without an auction, below the floor (in the source's currency)."""
    fixed = F.array_contains(options, "FIXED_PRICE") & ~F.array_contains(options, "AUCTION")
    return F.coalesce(fixed & (amount < floor), F.lit(False))


def over_floor(amount: Column, floor: float = AUCTION_FLOOR) -> Column:
    """Whether an unscoped auction's price, if it has one, reaches the floor."""
    return amount.isNull() | (amount >= floor)


def in_vehicle_tree(path: Column) -> Column:
    """Whether a category path (an array of names) holds the one of whole vehicles."""
    return F.coalesce(F.exists(path, lambda c: c.contains(WHOLE_VEHICLE)), F.lit(False))


def in_era(year: Column, unknown: bool) -> Column:
    """Whether the year is the model's; `unknown` says what a missing one counts as."""
    return F.coalesce(year.between(1971, 1980), F.lit(unknown))


def auction_title(title: Column) -> Column:
    """The number, no other generation, no part: what an unscoped auction's title must pass."""
    return number_alone(title) & ~other_generation(title) & ~any_of(title, PART_WORDS_JP)


def scoped_title(title: Column, era: Column) -> Column:
    """Among whole vehicles: no other generation, and the number or the model's name with a year of its era."""
    return ~other_generation(title) & (number_alone(title) | (title.contains(MODEL_NAME) & in_era(era, False)))


def wanted(title: Column) -> Column:
    """A brand's mark, no other generation by number or word, and a truck's mark."""
    other = F.lower(title).rlike(OTHER_NUMBER) | any_of(title, OTHER_WORDS)
    return any_of(title, BRANDS) & ~other & title.rlike(TRUCK)
