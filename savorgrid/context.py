"""City context as data: zones, affinities, name rules and guide lists.

A pack is user configuration. ``CityPack.load`` reads one from JSON; ``demo_pack`` is a
small synthetic city used by tests and examples. Lists up to a few hundred entries are
inlined into expressions; the ``*_frame`` methods give the same facts as lookup tables.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Box:
    lat_min: float
    lat_max: float
    lng_min: float
    lng_max: float


@dataclass(frozen=True)
class District:
    name: str
    lat: float
    lng: float
    tier: str = "mixed"


@dataclass(frozen=True)
class Quarter:
    """A small area inside a district, in priority order."""

    name: str
    district: str
    lat: float
    lng: float
    tier: str = "mixed"
    radius: float = 0.5
    affinity: tuple[str, ...] = ()


@dataclass(frozen=True)
class Street:
    name: str
    lat: float
    lng: float
    radius: float = 0.15


@dataclass(frozen=True)
class CategoryStreet:
    category: str
    name: str
    district: str
    lat: float
    lng: float


# Default weight of each kind of area.
TIER_WEIGHTS = {
    "tourist_heavy": -0.15, "tourist_trap": -0.20, "diaspora_hub": 0.15, "local_foodie": 0.10,
    "underexplored": 0.12, "eu_bubble": -0.05, "mixed": 0.0,
}

# Place types and the category they stand for.
TYPE_CATEGORIES = {
    "italian_restaurant": "Italian", "pizza_restaurant": "Italian", "french_restaurant": "French",
    "belgian_restaurant": "Belgian", "japanese_restaurant": "Japanese", "sushi_restaurant": "Japanese",
    "chinese_restaurant": "Chinese", "thai_restaurant": "Thai", "vietnamese_restaurant": "Vietnamese",
    "indian_restaurant": "Indian", "mexican_restaurant": "Mexican", "greek_restaurant": "Greek",
    "turkish_restaurant": "Turkish", "lebanese_restaurant": "Lebanese",
    "middle_eastern_restaurant": "Middle Eastern", "mediterranean_restaurant": "Mediterranean",
    "seafood_restaurant": "Seafood", "steak_house": "Steakhouse", "vegetarian_restaurant": "Vegetarian",
    "vegan_restaurant": "Vegan", "fast_food_restaurant": "Fast Food", "hamburger_restaurant": "Burger",
    "american_restaurant": "American", "korean_restaurant": "Korean", "spanish_restaurant": "Spanish",
    "asian_restaurant": "Asian", "african_restaurant": "African", "brazilian_restaurant": "Brazilian",
    "cafe": "Cafe", "coffee_shop": "Cafe", "bakery": "Bakery", "bar": "Bar",
    "brunch_restaurant": "Brunch", "breakfast_restaurant": "Breakfast",
}

# First cuisine tag of a map element and its category.
OSM_CATEGORIES = {
    "italian": "Italian", "french": "French", "belgian": "Belgian", "japanese": "Japanese",
    "chinese": "Chinese", "thai": "Thai", "indian": "Indian", "turkish": "Turkish", "moroccan": "Moroccan",
    "lebanese": "Lebanese", "greek": "Greek", "spanish": "Spanish", "mexican": "Mexican",
    "vietnamese": "Vietnamese", "korean": "Korean", "african": "African", "ethiopian": "Ethiopian",
    "congolese": "Congolese", "portuguese": "Portuguese", "american": "American", "burger": "American",
    "pizza": "Italian", "sushi": "Japanese", "seafood": "Seafood", "vegetarian": "Vegetarian",
    "vegan": "Vegan",
}

# Place types that are not places to eat.
NOT_FOOD_TYPES = [
    "hotel", "motel", "hostel", "lodging",
    "sauna", "spa", "gym", "fitness_center", "beauty_salon",
    "hair_salon", "wellness_center", "massage", "public_bath",
    "furniture_store", "home_goods_store", "home_improvement_store",
    "clothing_store", "shopping_mall", "department_store",
    "movie_theater", "night_club", "casino",
]
GROCERY_TYPES = ["supermarket", "grocery_store", "convenience_store"]
FUEL_TYPES = ["gas_station", "fuel_station", "petrol_station"]


@dataclass
class CityPack:
    city: str
    box: Box
    centre: tuple[float, float]
    office_hub: tuple[float, float]
    default_district: str
    districts: list[District]
    quarters: list[Quarter] = field(default_factory=list)
    streets: list[Street] = field(default_factory=list)
    tier_weights: dict[str, float] = field(default_factory=lambda: dict(TIER_WEIGHTS))
    crowd_quarters: list[str] = field(default_factory=list)
    affinity: dict[str, dict[str, float]] = field(default_factory=dict)
    local_affinity: dict[str, dict[str, float]] = field(default_factory=dict)
    fry_shop_scores: dict[str, float] = field(default_factory=dict)
    category_streets: list[CategoryStreet] = field(default_factory=list)
    category_languages: dict[str, list[str]] = field(default_factory=dict)
    community_notes: dict[str, str] = field(default_factory=dict)
    specificity: dict[str, float] = field(default_factory=dict)
    rare: dict[str, float] = field(default_factory=dict)
    chain_patterns: list[str] = field(default_factory=list)
    excluded_names: list[str] = field(default_factory=list)
    excluded_types: list[str] = field(default_factory=lambda: GROCERY_TYPES + NOT_FOOD_TYPES)
    removed_types: list[str] = field(default_factory=lambda: NOT_FOOD_TYPES + FUEL_TYPES)
    shop_patterns: list[str] = field(default_factory=list)
    closed_names: list[str] = field(default_factory=list)
    institutions: dict[str, float] = field(default_factory=dict)
    known_fry_shops: list[str] = field(default_factory=list)
    star_names: dict[str, int] = field(default_factory=dict)
    star_exact: dict[str, int] = field(default_factory=dict)
    bib_names: list[str] = field(default_factory=list)
    guide_names: list[str] = field(default_factory=list)
    guide_exact: list[str] = field(default_factory=list)
    category_overrides: list[tuple[str, list[str]]] = field(default_factory=list)
    type_categories: dict[str, str] = field(default_factory=lambda: dict(TYPE_CATEGORIES))
    category_keywords: list[tuple[str, list[str]]] = field(default_factory=list)
    community_categories: list[str] = field(default_factory=list)
    spotlight_districts: list[str] = field(default_factory=list)
    priority_categories: list[str] = field(default_factory=list)
    plain_categories: list[str] = field(default_factory=list)
    candidate_skip_words: list[str] = field(default_factory=list)
    fast_food_categories: list[str] = field(default_factory=list)
    hip_words: list[str] = field(
        # Names that do not speak for a community kitchen.
        default_factory=lambda: [
            "eatery", "kitchen", "factory", "lab", "workshop", "studio", "house", "corner", "spot",
        ]
    )
    hall_words: list[str] = field(default_factory=list)
    register_postcodes: list[str] = field(default_factory=list)
    review_themes: dict[str, list[str]] = field(default_factory=dict)
    stop_words: list[str] = field(default_factory=lambda: ["de", "la", "le", "du", "des", "l", "d"])

    # --- loading and overriding ---------------------------------------------

    @classmethod
    def from_dict(cls, raw: dict) -> "CityPack":
        raw = dict(raw)
        made = {
            "box": lambda v: Box(**v),
            "centre": tuple,
            "office_hub": tuple,
            "districts": lambda v: [District(**d) for d in v],
            "quarters": lambda v: [Quarter(**{**q, "affinity": tuple(q.get("affinity", ()))}) for q in v],
            "streets": lambda v: [Street(**s) for s in v],
            "category_streets": lambda v: [CategoryStreet(**s) for s in v],
            "category_overrides": lambda v: [(a, list(b)) for a, b in v],
            "category_keywords": lambda v: [(a, list(b)) for a, b in v],
        }
        known = {f.name for f in fields(cls)}
        unknown = set(raw) - known
        if unknown:
            raise ValueError(f"unknown pack entries: {sorted(unknown)}")
        return cls(**{k: made.get(k, lambda v: v)(v) for k, v in raw.items()})

    @classmethod
    def load(cls, path: str, defaults: "CityPack | None" = None) -> "CityPack":
        """Read a pack from JSON; entries it leaves out come from ``defaults``."""
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        base = asdict(defaults) if defaults else {}
        return cls.from_dict({**base, **raw})

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, ensure_ascii=False, indent=1)

    # --- lookup tables --------------------------------------------------------

    def district_frame(self, spark: SparkSession) -> DataFrame:
        return _frame(
            spark,
            [
                {
                    "ord": i, "district": d.name, "lat": d.lat, "lng": d.lng, "tier": d.tier,
                    "weight": self.tier_weights.get(d.tier, 0.0),
                }
                for i, d in enumerate(self.districts)
            ],
            "ord int, district string, lat double, lng double, tier string, weight double",
        )

    def quarter_frame(self, spark: SparkSession) -> DataFrame:
        return _frame(
            spark,
            [
                {
                    "ord": i, "quarter": q.name, "district": q.district, "lat": q.lat, "lng": q.lng,
                    "tier": q.tier, "radius": q.radius,
                }
                for i, q in enumerate(self.quarters)
            ],
            "ord int, quarter string, district string, lat double, lng double, tier string, radius double",
        )

    def street_frame(self, spark: SparkSession) -> DataFrame:
        return _frame(
            spark,
            [{"ord": i, **asdict(s)} for i, s in enumerate(self.streets)],
            "ord int, name string, lat double, lng double, radius double",
        )

    def affinity_frame(self, spark: SparkSession) -> DataFrame:
        """(category, district) scores of both matrices."""
        pairs: dict[tuple[str, str], dict] = {}
        for column, matrix in (("community", self.affinity), ("local", self.local_affinity)):
            for category, scores in matrix.items():
                for district, score in scores.items():
                    row = {"category": category, "district": district, "community": None, "local": None}
                    pairs.setdefault((category, district), row)[column] = float(score)
        return _frame(
            spark, list(pairs.values()), "category string, district string, community double, local double"
        )

    def category_frame(self, spark: SparkSession) -> DataFrame:
        """One row per category that carries any fact."""
        names = dict.fromkeys(
            [*self.affinity, *self.rare, *self.specificity, *self.category_languages, *self.community_notes]
            + [s.category for s in self.category_streets]
        )
        rows = []
        for name in names:
            streets = [s for s in self.category_streets if s.category == name]
            rows.append(
                {
                    "category": name,
                    "has_affinity": name in self.affinity,
                    "rare": float(self.rare.get(name, 0.0)),
                    "specificity": float(self.specificity.get(name, 0.0)),
                    "languages": self.category_languages.get(name),
                    "note": self.community_notes.get(name),
                    "streets": [
                        {"name": s.name, "district": s.district, "lat": s.lat, "lng": s.lng} for s in streets
                    ]
                    or None,
                }
            )
        return _frame(
            spark,
            rows,
            "category string, has_affinity boolean, rare double, specificity double, "
            "languages array<string>, note string, "
            "streets array<struct<name:string,district:string,lat:double,lng:double>>",
        )


_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(),
    "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
    "array<struct<name:string,district:string,lat:double,lng:double>>": pa.list_(
        pa.struct(
            [("name", pa.string()), ("district", pa.string()), ("lat", pa.float64()), ("lng", pa.float64())]
        )
    ),
}


def _frame(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A local table of known size, so that the optimizer itself decides on broadcasting it."""
    cols = [c.strip().split(" ", 1) for c in ddl.split(", ")]
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in cols])
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


# --- a synthetic city ----------------------------------------------------------

_TIERS = ["underexplored", "local_foodie", "tourist_heavy", "eu_bubble", "mixed", "diaspora_hub"]


def demo_pack() -> CityPack:
    """An invented city laid over the test venues."""
    districts = [
        District(f"District {i + 1:02d}", round(50.775 + (i % 4) * 0.04, 4), round(4.28 + (i // 4) * 0.04, 4),
                 _TIERS[i % 6])
        for i in range(19)
    ]
    quarters = [
        Quarter(
            f"Quarter {i + 1:02d}",
            f"District {i + 1:02d}",
            round(50.78 + (i % 5) * 0.025, 4),
            round(4.29 + (i * 7 % 13) * 0.014, 4),
            ["local_foodie", "tourist_trap", "eu_bubble", "mixed"][i % 4],
            [0.5, 0.8, 1.1][i % 3],
            ("Turkish",) if i % 2 else ("Belgian", "Cafe"),
        )
        for i in range(13)
    ]
    streets = [
        Street(
            f"{['Market', 'Harbour', 'Mill', 'Garden'][i % 4]} Row {i + 1} (Old Town)" if i % 3 == 0
            else f"{['Market', 'Harbour', 'Mill', 'Garden'][i % 4]} Way {i + 1}",
            round(50.77 + (i * 5 % 36) * 0.0037, 4),
            round(4.27 + (i * 11 % 36) * 0.0056, 4),
            [0.25, 0.4, 0.6][i % 3],
        )
        for i in range(36)
    ]
    names = [d.name for d in districts]
    return CityPack(
        city="Demo",
        box=Box(50.77, 50.90, 4.27, 4.47),
        centre=(50.83, 4.374),
        office_hub=(50.82, 4.40),
        default_district="District 03",
        districts=districts,
        quarters=quarters,
        streets=streets,
        crowd_quarters=["Quarter 06"],
        affinity={
            "Turkish": {n: round(1.0 - 0.05 * i, 2) for i, n in enumerate(names[:12])},
            "Lebanese": {n: 0.75 for n in names[4:9]},
            "Fast Food": {n: 0.35 for n in names[::5]},
        },
        local_affinity={
            "Belgian": {n: 0.9 for n in names[::3]},
            "Turkish": {names[15]: 0.5, names[1]: 0.97},
        },
        fry_shop_scores={n: round(1.0 - 0.04 * i, 2) for i, n in enumerate(names[:12])},
        category_streets=[
            CategoryStreet(
                ["Turkish", "Lebanese", "Cafe"][i % 3],
                ["Harbour Quay", "Old Town", "Mill (Upper) Bridge", "The Arcade"][i % 4],
                names[(i * 5) % 19],
                round(50.775 + (i % 6) * 0.021, 4),
                round(4.28 + (i * 3 % 12) * 0.016, 4),
            )
            for i in range(18)
        ],
        category_languages={"Turkish": ["tr"], "Lebanese": ["ar", "fr"]},
        community_notes={"Turkish": "Bakeries and grills since the sixties", "Lebanese": "Family tables by the mill"},
        specificity={"Cafe": 0.0, "Belgian": 0.4, "Fast Food": 0.8, "Hawaiian": 1.0},
        rare={"Hawaiian": 1.0, "Belgian": 0.7},
        chain_patterns=[r"^hot ", r"anvil\b", r"plate\s*[&e]\s*rod"],
        excluded_names=[r"\bcold gizmo\b", r"^new plate", r"wellness"],
        shop_patterns=[r"\bwidget promo$", r"^old rod "],
        closed_names=["red ring medium", "chez small bolt large"],
        institutions={"gizmo promo": 1.0, "cafe blue": 0.9, "sile": 0.85},
        known_fry_shops=["rod economy"],
        star_names={"blue gear": 2, "red gear": 1, "large ring": 1},
        star_exact={"new bolt small": 2},
        bib_names=["small plate", "l'old", "hot rod"],
        guide_names=["red gear", "cold ring", "new widget"],
        guide_exact=["new bolt small"],
        category_overrides=[("Hawaiian", ["gizmo small", "poke bowl"])],
        category_keywords=[
            ("French", ["chez ", "maison"]),
            ("Grill", ["anvil", "hot rod"]),
            ("Seafood", ["blue", "cold ring"]),
            ("Bakery", ["plate", "ring"]),
        ],
        community_categories=["Turkish", "Lebanese", "Hawaiian"],
        spotlight_districts=names[::6],
        priority_categories=["Turkish", "Lebanese", "Greek"],
        plain_categories=["Restaurant", "Sandwich", "Kebab", "Coffee_Shop"],
        candidate_skip_words=["hotel", "cold gizmo", "rod promo"],
        fast_food_categories=["Sandwich", "Kebab", "Friture"],
        hall_words=["food hall", "casino", "station", "ring large"],
        review_themes={
            "crowd": ["coach party", "queue", "overrated"],
            "kitchen": ["own bread", "family recipe", "slow cooked"],
        },
        register_postcodes=[str(1000 + 10 * i) for i in range(20)],
    )
