"""Sentences that explain each score: a fact from the components, a clause that sets it against the city, and one against the neighborhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flags import Row

#: Flags of scores that come from missing records, which aren't compared with peers.
ABSENT = ("not_required", "never_filed", "new_building", "match_uncertain")


def whole(c: Column) -> Column:
    """A number rounded half to even, with thousands separators."""
    return F.when(c.isNotNull(), F.format_string("%,d", F.rint(c.cast("double")).cast("long")))


def short(c: Column, places: int) -> Column:
    """A number with at most so many decimals, without zeros at the end."""
    t = F.when(c.isNotNull(), F.format_string(f"%.{places}f", c.cast("double")))
    return F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "") if places else t


def metres(c: Column) -> Column:
    m = c.cast("double")
    return F.when(m >= 1000, F.concat(short(m / 1000, 1), F.lit(" km"))).otherwise(F.concat(whole(m), F.lit(" m")))


def counted(c: Column, one: str, many: str | None = None) -> Column:
    return F.concat(whole(c), F.lit(" "), F.when(F.rint(c.cast("double")) == 1, one).otherwise(many or one + "s"))


def owner_title(c: Column) -> Column:
    out = F.initcap(F.lower(c))
    for a in ("Llc", "Lp", "Nyc", "Hdfc", "Corp.", "Inc."):
        out = F.replace(out, F.lit(a), F.lit(a.upper()))
    return out


def capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 10_000))


def joined(parts: list[Column], last: str) -> Column:
    """The parts that aren't null, parted by commas or, for the last, by ``last``."""
    a = F.array_compact(F.array(*parts))
    n = F.size(a)
    return F.when(n == 0, None).when(n == 1, F.get(a, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(a, F.lit(1), n - 1), ", "), F.lit(last), F.get(a, n - 1)))


def _say(*parts: Column | str) -> Column:
    """The parts one after the other; a null part is left out."""
    return F.concat(*(F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))


def builders(r: Row) -> dict[str, tuple[Column, Column, Column]]:
    """{dim: (fact, clause, good)}; a null fact falls back on the score alone."""
    sc = lambda d: getattr(r, f"{d}_score").cast("double")
    good = lambda d: sc(d) >= 50
    better, worse = (lambda d: F.rint(sc(d)).cast("int").cast("string")), (lambda d: F.rint(100 - sc(d)).cast("int").cast("string"))
    clause = lambda d, up, down: F.when(good(d), _say(*(better(d) if x is None else x for x in up))).otherwise(_say(*(worse(d) if x is None else x for x in down)))
    none = F.lit(None).cast("string")
    v = lambda name: getattr(r, name).cast("double")
    out: dict[str, tuple[Column, Column, Column]] = {}

    price, med = v("price"), v("comp_median")
    diff = (price - med) / med * 100
    word = F.when(F.coalesce(F.nullif(r.s("comp_scope"), F.lit("")), F.lit("neighborhood")).isin("neighborhood", "borough"), F.coalesce(F.nullif(r.s("comp_scope"), F.lit("")), F.lit("neighborhood"))).otherwise("market")
    held = F.when(F.abs(diff) < 2, _say("Priced right at the ", word, " median ($", whole(med), ") for comparable units")).when(diff < 0, _say("Priced ", whole(F.abs(diff)), "% below the ", word, " median of $", whole(med), " for comparable units")).otherwise(_say("Priced ", whole(diff), "% above the ", word, " median of $", whole(med), " for comparable units"))
    foot = v("price_per_sqft")
    out["deal"] = (F.when((price != 0) & (med != 0), held).when(foot != 0, _say("Rents at $", short(foot, 2), "/sqft")), clause("deal", ("a better deal than ", None, "% of NYC"), ("pricier than ", None, "% of NYC for what you get")), good("deal"))

    p, s = v("unit_amenities_premium"), v("unit_amenities_standard")
    some = joined([F.concat(whole(p), F.lit(" premium")), F.concat(whole(s), F.lit(" standard"))], " and ")
    out["unit_amenities"] = (F.when(p.isNotNull() | s.isNotNull(), F.when(F.coalesce(p, F.lit(0.0)) + F.coalesce(s, F.lit(0.0)) == 0, "No in-unit amenities listed").otherwise(_say(some, " in-unit amenities listed"))), clause("unit_amenities", ("better equipped than ", None, "% of NYC listings"), ("more sparsely equipped than ", None, "% of NYC listings")), good("unit_amenities"))

    near, st, ro = v("transit_nearest_m"), v("transit_station_count"), v("transit_routes_served")
    reach = joined([counted(st, "station"), F.when(ro == 1, "1 route").otherwise(F.concat(whole(ro), F.lit(" unique routes")))], " and ")
    out["transit"] = (F.when(near < 9000, _say("Nearest subway station ", metres(near), " away", F.when(reach.isNotNull(), _say("; ", reach, " within a 10-minute walk")))).when(reach.isNotNull(), _say(capital(reach), " within a 10-minute walk")), none, good("transit"))

    crime = joined([counted(v("crime_felony_count"), "felony", "felonies"), counted(v("crime_misdemeanor_count"), "misdemeanor")], " and ")
    out["crime"] = (F.when(crime.isNotNull(), _say(crime, " within ~4 blocks in the last year")), clause("crime", ("lower than ", None, "% of NYC"), ("more than ", None, "% of NYC")), good("crime"))

    band = lambda d, steps, rest: F.coalesce(*(F.when(sc(d) >= at, F.lit(t)) for at, t in steps if t), F.lit(rest))
    x = sc("noise")
    loud = F.when(x >= 75, "quiet by city standards").when(x >= 55, "quieter than average for NYC").when(x >= 35, none).when(x >= 15, "noisier than most of NYC").otherwise("loud by city standards")
    out["noise"] = (F.when(v("noise_complaint_count").isNotNull(), _say(counted(v("noise_complaint_count"), "noise complaint"), " within ~1 block last year", F.when(v("noise_rate_per_khh").isNotNull(), F.format_string(" (%.0f per 1,000 households)", v("noise_rate_per_khh"))))), loud, good("noise"))

    dob, cc, per = v("building_violation_count"), v("building_hpd_class_c"), v("building_violations_per_unit")
    hazard = counted(cc, "hazardous HPD Class C violation")
    clean = _say("No open DOB violations in this building", F.when(cc > 0, _say(", but ", hazard)))
    some_dob = _say(counted(dob, "open DOB violation"), " in this building", F.when(per.isNotNull(), _say(" (", short(per, 2), " per unit)")), F.when(cc > 0, _say(", plus ", hazard)))
    out["building_violations"] = (F.when(dob.isNotNull(), F.when(dob == 0, clean).otherwise(some_dob)), none, good("building_violations") & ~F.coalesce((dob == 0) & (cc > 0), F.lit(False)))

    name, acres, far = F.nullif(r.s("parks_name"), F.lit("")), v("parks_acres"), v("parks_distance_m")
    out["parks"] = (F.when(far.isNotNull(), F.when(name.isNotNull(), _say(name, F.when(acres.isNotNull(), _say(" (", short(acres, 1), " acres)")), " is ", metres(far), " away")).otherwise(_say("Nearest park ", metres(far), " away"))), none, good("parks"))

    school = F.nullif(r.s("school_name"), F.lit(""))
    out["schools"] = (F.when(school.isNotNull(), _say("Zoned near ", school, F.when(v("school_rating").isNotNull(), _say(", rated ", whole(v("school_rating")), "/100")))), none, good("schools"))

    owner, cpu = F.nullif(r.s("mgmt_owner"), F.lit("")), v("mgmt_complaints_per_unit")
    size = F.when((v("mgmt_owner_buildings") != 0) & (v("mgmt_owner_units") != 0), _say(" (", counted(v("mgmt_owner_buildings"), "building"), ", ", counted(v("mgmt_owner_units"), "unit"), ")"))
    lead = F.when(owner.isNotNull(), _say(owner_title(owner), "'s portfolio", size)).otherwise("Landlord portfolio")
    rate = F.when((cpu > 0) & (cpu < 0.01), "under 0.01").otherwise(short(cpu, 2))
    extras = joined([F.when(v("mgmt_litigations") > 0, counted(v("mgmt_litigations"), "open HPD litigation")), F.when(v("mgmt_evictions") > 0, counted(v("mgmt_evictions"), "eviction filing"))], " and ")
    told = F.when(cpu.isNotNull(), _say(lead, " averages ", rate, " HPD complaints per unit")).when(owner.isNotNull(), _say("Building is owned by ", owner_title(owner)))
    out["management"] = (F.when(told.isNotNull(), _say(told, F.when(extras.isNotNull(), _say(", with ", extras)))), F.when(good("management"), "better than most NYC landlords").otherwise(_say("worse than ", worse("management"), "% of NYC landlords")), good("management"))

    c = lambda n: v(f"convenience_{n}")
    shops = joined([counted(c("grocery"), "grocery store"), F.when(c("pharmacy") > 0, counted(c("pharmacy"), "pharmacy", "pharmacies")), counted(c("dining"), "restaurant"), F.when(c("gym") > 0, counted(c("gym"), "gym")), F.when(c("laundry") > 0, counted(c("laundry"), "laundromat"))], ", and ")
    out["convenience"] = (F.when(shops.isNotNull(), _say(shops, " within a short walk")), none, good("convenience"))

    n, m, pr = v("shelter_count"), v("shelter_nearest_m"), v("project_count")
    homes = F.when(n == 0, "No homeless shelters within a half-mile").when(n.isNotNull(), _say(counted(n, "homeless shelter"), " within a half-mile", F.when(m < 9000, _say(" (nearest ", metres(m), ")"))))
    both = F.array_join(F.array_compact(F.array(homes, F.when(pr == 0, "no NYCHA developments nearby").when(pr.isNotNull(), _say(counted(pr, "NYCHA development"), " nearby")))), "; ")
    out["shelter"] = (F.when(n.isNotNull() | pr.isNotNull(), capital(both)), none, good("shelter"))

    h, ro = v("pest_hpd_count"), v("pest_rodent_count")
    pests = F.array_join(F.array_compact(F.array(F.when(h == 0, "No pest complaints in this building").when(h.isNotNull(), _say(counted(h, "pest complaint"), " in this building")), F.when(ro == 0, "no rodent reports on the block last year").when(ro.isNotNull(), _say(counted(ro, "rodent report"), " on the block last year")))), "; ")
    out["pest"] = (F.when(h.isNotNull() | ro.isNotNull(), capital(pests)), none, good("pest"))

    out["greenery"] = (F.when(v("greenery_tree_count").isNotNull(), _say(counted(v("greenery_tree_count"), "street tree"), " within ~2 blocks", F.when(v("greenery_garden_count") > 0, _say(" and ", counted(v("greenery_garden_count"), "community garden"), " nearby")))), band("greenery", ((75, "greener than most of NYC"), (50, "more greenery than the city average"), (25, "less green than most of NYC")), "one of the least green blocks in the city"), good("greenery"))

    f, inf, re = v("bedbug_filings"), v("bedbug_infested_total"), v("bedbug_reinfested_total")
    annual = counted(f, "annual bedbug filing")
    bugs = F.when(F.coalesce(f, F.lit(0.0)) == 0, "No bedbug filings on record for this building").when(inf.isNull(), _say(annual, " on record for this building")).when(inf == 0, _say(annual, " on record, none reporting an infestation")).otherwise(_say(counted(inf, "bedbug infestation"), " reported in this building's filing history", F.when(re > 0, _say(", including ", counted(re, "re-infestation")))))
    out["bedbug"] = (bugs, none, good("bedbug"))

    inj, dead = v("street_danger_injuries"), v("street_danger_deaths")
    hurt = joined([counted(inj, "pedestrian or cyclist injury", "pedestrian and cyclist injuries"), F.when(dead > 0, counted(dead, "death"))], " and ")
    safe = F.coalesce(inj, F.lit(0.0)) + F.coalesce(dead, F.lit(0.0)) == 0
    out["street_danger"] = (F.when(inj.isNotNull() | dead.isNotNull(), F.when(safe, "No pedestrian or cyclist injuries within ~3 blocks in the last year").otherwise(_say(hurt, " within ~3 blocks in the last year"))), F.when(~safe, clause("street_danger", ("safer streets than ", None, "% of NYC"), ("more dangerous than ", None, "% of NYC"))), good("street_danger"))

    air = joined([F.when(v("air_quality_pm25").isNotNull(), _say("annual average PM2.5 of ", short(v("air_quality_pm25"), 1), " µg/m³")), F.when(v("air_quality_no2").isNotNull(), _say("NO2 of ", short(v("air_quality_no2"), 1), " ppb"))], " and ")
    out["air_quality"] = (F.when(v("air_quality_pm25").isNotNull(), capital(air)).when(v("air_quality_no2").isNotNull(), _say("NO2 of ", short(v("air_quality_no2"), 1), " ppb")), clause("air_quality", ("cleaner air than ", None, "% of NYC"), ("worse air than ", None, "% of NYC")), good("air_quality"))

    hw, rows, el, truck, art = v("road_exposure_hwy_dist_m"), r.n("road_exposure_hwy_shield_rows"), v("road_exposure_el_dist_m"), r.n("road_exposure_truck"), r.n("road_exposure_arterial")
    shield = F.when(rows >= 1, _say(", though ", rows.cast("int").cast("string"), F.when(rows > 1, " rows").otherwise(" row"), " of buildings shield this block from it"))
    roads = F.array_compact(F.array(F.when(hw <= 500, _say("A highway passes ", metres(hw), " away", shield)), F.when(el <= 400, _say("an elevated train runs ", metres(el), " away")), F.when(truck >= 1.5, "it fronts a designated truck route — rear-facing units will hear far less").when(art >= 4, "it fronts busy surface streets")))
    out["road_exposure"] = (F.when(F.size(roads) == 0, "Quiet side-street profile — no highways, elevated trains, or truck routes close by").otherwise(capital(F.array_join(roads, "; "))), clause("road_exposure", ("quieter street exposure than ", None, "% of NYC listings"), ("more road noise than ", None, "% of NYC listings")), good("road_exposure"))
    return out


def peer_tail(percentile: Column, neighborhood: Column, citywide_good: Column) -> Column:
    """How a listing stands in its neighborhood, with a word of contrast or agreement with its standing in the city (null: none)."""
    hood = F.coalesce(F.nullif(neighborhood, F.lit("")), F.lit("this area"))
    p = percentile.cast("double")
    phrase = F.when(p >= 80, _say("among the best in ", hood, " for this")).when(p >= 55, _say("better than most ", hood, " listings")).when(p >= 45, _say("mid-pack for ", hood)).when(p >= 10, _say("ranks below most ", hood, " listings here")).otherwise(_say("ranks in ", hood, "'s bottom tier for this"))
    peer_good = F.when(p >= 55, True).when(p >= 45, None).otherwise(False)
    word = F.when(citywide_good.isNull(), " — ").when(peer_good.isNull(), F.when(citywide_good, ", though ").otherwise(", but ")).when(citywide_good != peer_good, ", but ").otherwise(", and ")
    return F.when(p.isNull(), "").otherwise(F.concat(word, phrase))


def explanations(df: DataFrame, peers: DataFrame | None = None, key: str = "id", labels: dict[str, str] | None = None) -> DataFrame:
    """(key, dim, sentence) for each dimension with a score. peers: (key, dim, percentile) of rank.peer_context."""
    r, labels = Row(df), labels or {}
    items = []
    for dim, (fact, clause, good) in builders(r).items():
        if f"{dim}_score" not in r.names:
            continue
        score = getattr(r, f"{dim}_score").cast("double")
        plain = _say("Scores better than ", F.rint(score).cast("int").cast("string"), "% of NYC listings for ", labels.get(dim, dim.replace("_", " ")))
        absent = F.lit(False)
        for a in ABSENT:
            absent = absent | (r.n(f"{dim}_{a}") != 0)
        has_clause = fact.isNotNull() & clause.isNotNull()
        text = _say(F.coalesce(fact, plain), F.when(has_clause, _say(" — ", clause)))
        items.append(F.when(score.isNotNull(), F.struct(F.lit(dim).alias("dim"), text.alias("text"), F.when(has_clause, good).alias("good"), absent.alias("absent"))))
    hood = F.col("neighborhood") if "neighborhood" in r.names else F.lit(None).cast("string")
    rows = df.select(key, hood.alias("__hood"), F.explode(F.array_compact(F.array(*items))).alias("x")).select(key, "__hood", "x.*")
    if peers is None:
        return rows.select(key, "dim", F.concat("text", F.lit(".")).alias("sentence"))
    rows = rows.join(peers.select(key, "dim", "percentile"), [key, "dim"], "left")
    tail = F.when(F.col("absent"), "").otherwise(peer_tail(F.col("percentile"), F.col("__hood"), F.col("good")))
    return rows.select(key, "dim", F.concat("text", tail, F.lit(".")).alias("sentence"))
