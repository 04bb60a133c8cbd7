"""Rules over listings and building records that give coloured flags, as column expressions. A column that is missing counts as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Row:
    """The columns of a table by name; null where there is no such column."""

    def __init__(self, df: DataFrame, prefix: str = ""):
        self.names, self.prefix = set(df.columns), prefix

    def __getattr__(self, name: str) -> Column:
        return F.col(self.prefix + name) if name in self.names or self.prefix else F.lit(None).cast("double")

    def n(self, name: str) -> Column:
        """A number, 0 for null."""
        return F.coalesce(getattr(self, name).cast("double"), F.lit(0.0))

    def s(self, name: str) -> Column:
        return F.coalesce(getattr(self, name).cast("string"), F.lit(""))


def flag(colour: str, pattern: str, *values: Column) -> Column:
    return F.struct(F.lit(colour).alias("type"), (F.format_string(pattern, *values) if values else F.lit(pattern)).alias("text"))


def _int(c: Column) -> Column:
    return c.cast("int")


def _trend(r: Row, what: str, up: tuple[str, str, str, str]) -> Column:
    """Flags of a trend of five percent or more: a fall is good unless the score is poor, a rise is bad unless it is high."""
    ratio, way, score = F.coalesce(getattr(r, f"{what}_trend_ratio"), F.lit(1.0)), r.s(f"{what}_trend_direction"), getattr(r, f"{what}_score")
    ratio = F.when(ratio == 0, 1.0).otherwise(ratio)
    pct = _int(F.abs(F.rint((1 - ratio) * 100)))
    down_poor, down, up_high, up_low = up
    out = F.when(way == "improving", F.when(score < 30, flag("yellow", down_poor, pct)).otherwise(flag("green", down, pct)))
    out = out.when(way == "worsening", F.when(score >= 70, flag("yellow", up_high, pct)).otherwise(flag("red" if what == "crime" else "yellow", up_low, pct)))
    return F.when(pct >= 5, out)


def _units(r: Row, *names: str) -> Column:
    out = F.lit(None).cast("double")
    for n in names:
        out = F.coalesce(out, F.nullif(getattr(r, n).cast("double"), F.lit(0.0)))
    return F.greatest(F.coalesce(out, F.lit(1.0)), F.lit(1.0))


def rules(r: Row) -> dict[str, Column]:
    """{rule: flag or null} in the order of reports."""
    any_of = lambda suffix: F.greatest(*(r.n(f"{d}_{suffix}") for d in ("building_violations", "management", "bedbug", "pest"))) > 0
    n, i = r.n, lambda c: _int(r.n(c))
    b_units, m_units = _units(r, "building_unitsres"), _units(r, "mgmt_owner_units")
    dob, per_dob = n("building_violation_count"), n("building_violation_count") / b_units
    comp, per_comp = n("mgmt_complaints"), n("mgmt_complaints") / m_units
    c, per_c = n("building_hpd_class_c"), n("building_hpd_class_c") / b_units
    ev, e_units = n("mgmt_evictions"), _units(r, "building_unitsres", "mgmt_owner_units")
    per_ev = ev / e_units
    hpd, rodent, p_units = n("pest_hpd_count"), n("pest_rodent_count"), _units(r, "pest_units", "building_unitsres")
    per_pest, area = hpd / p_units, (i("pest_hpd_count"), i("pest_rodent_count"))
    dist, name, acres = r.parks_distance_m, r.s("parks_name"), n("parks_acres")
    foot = F.when(n("price_per_sqft") != 0, F.format_string(" ($%.0f/sqft)", n("price_per_sqft"))).otherwise("")
    tenure, relists = r.tenure_median_months.cast("double"), n("relist_count")
    shelter_m, project_m = F.coalesce(F.nullif(r.shelter_nearest_m.cast("int"), F.lit(0)), F.lit(9999)), F.coalesce(F.nullif(r.project_nearest_m.cast("int"), F.lit(0)), F.lit(9999))
    label = lambda column, other: F.when(r.s(column) != "", F.substring(r.s(column), 1, 40)).otherwise(other)
    count, deal, cut, days = r.transit_station_count, r.deal_score, r.deal_price_cut_pct.cast("double"), r.deal_cut_recency_days.cast("double")
    known = lambda *columns: F.greatest(*(getattr(r, c).isNotNull() for c in columns)) if len(columns) > 1 else getattr(r, columns[0]).isNotNull()
    return {
        "crime_trend": _trend(r, "crime", ("High crime area, but down %d%% over 6 months", "Crime down %d%% over 6 months", "Crime up %d%% over 6 months (still low overall)", "Crime up %d%% over 6 months")),
        "noise_trend": _trend(r, "noise", ("Noisy area, but complaints down %d%%", "Noise complaints down %d%%", "Noise complaints up %d%% (still quiet overall)", "Noise complaints up %d%%")),
        "rent_stabilized": F.when(n("rent_stabilized") != 0, flag("green", "Rent-stabilized unit")),
        "building_data_states": F.when(any_of("new_building"), flag("yellow", "New building — no compliance track record yet")).when(any_of("match_uncertain"), flag("yellow", "Building records may not match this exact address")),
        "bedbug_never_filed": F.when((n("bedbug_never_filed") != 0) & (n("building_unitsres") >= 5), flag("yellow", "Owner has never filed the required annual bedbug report")),
        "stabilized_unicorn": F.when(n("deal_stabilized_below_median") != 0, flag("green", "Rent-stabilized and priced below market — the discount compounds at renewal")),
        "price_cut_leverage": F.when((cut >= 2.0) & (days <= 30), flag("green", "Price cut %.0f%% %d days ago — landlord signaling flexibility", cut, _int(days))),
        "transit": F.when(count >= 4, flag("green", "%d subway stations within walking distance", _int(count))).when(count == 0, flag("red", "No subway stations nearby")),
        "violations": F.when(known("building_violation_count"), F.when(dob == 0, flag("green", "No open building violations")).when(
            b_units >= 20, F.when(per_dob >= 0.5, flag("red", "%d open DOB violations (%.2f/unit)", _int(dob), per_dob)).when(per_dob >= 0.2, flag("yellow", "%d open DOB violations (%.2f/unit)", _int(dob), per_dob))
        ).when(dob >= 3, flag("red", "%d open DOB violations", _int(dob))).otherwise(flag("yellow", "%d open DOB violation(s)", _int(dob)))),
        "hpd_class_c": F.when(known("building_hpd_class_c") & (c > 0), F.when(
            b_units >= 50, F.when(per_c >= 0.02, flag("red", "%d hazardous (Class C) HPD violations (%.1f%% of units)", _int(c), per_c * 100)).when(per_c >= 0.005, flag("yellow", "%d hazardous (Class C) HPD violation(s)", _int(c)))
        ).when(c >= 3, flag("red", "%d hazardous (Class C) HPD violations", _int(c))).otherwise(flag("yellow", "%d hazardous (Class C) HPD violation(s)", _int(c)))),
        "management": F.when(known("mgmt_complaints"), F.when(comp == 0, flag("green", "No HPD complaints on record")).when(
            m_units >= 50, F.when(per_comp >= 0.3, flag("red", "Management: %d HPD complaints (%.2f/unit)", _int(comp), per_comp)).when(per_comp >= 0.1, flag("yellow", "Management: %d HPD complaints (%.2f/unit)", _int(comp), per_comp))
        ).when(comp >= 10, flag("red", "Management: %d HPD complaints", _int(comp))).when(comp >= 5, flag("yellow", "Management: %d HPD complaints", _int(comp)))),
        "litigations": F.when(n("mgmt_litigations") >= 1, flag("red", "Building has %d open HPD litigation(s)", i("mgmt_litigations"))),
        "evictions": F.when(known("mgmt_evictions") & (ev > 0), F.when(
            e_units >= 50, F.when(per_ev >= 0.05, flag("red", "%d eviction filings (%.1f%% of units)", _int(ev), per_ev * 100)).when(per_ev >= 0.02, flag("yellow", "%d eviction filings (%.1f%% of units)", _int(ev), per_ev * 100))
        ).when(ev >= 5, flag("red", "%d eviction filings at this building", _int(ev))).when(ev >= 2, flag("yellow", "%d eviction filings nearby", _int(ev)))),
        "flood_risk": F.when(F.coalesce(r.flood_risk_score, F.lit(100.0)) < 30, flag("red", "Located in a FEMA flood zone")),
        "parks": F.when(dist.isNotNull() & (name != ""), F.when((acres >= 100) & (dist <= 500), flag("green", "Near %s (%d acres, %dm)", name, _int(acres), _int(dist))).when((acres >= 15) & (dist <= 300), flag("green", "%s within %dm (%d acres)", name, _int(dist), _int(acres))).when((acres >= 3) & (dist <= 150), flag("green", "%s within %dm", name, _int(dist)))),
        "deal": F.when(deal >= 80, flag("green", "Priced well below neighborhood median%s", foot)).when(deal <= 20, flag("red", "Priced above neighborhood median%s", foot)),
        "no_fee": F.when(n("no_fee") != 0, flag("green", "No broker fee")),
        "relist": F.when(tenure > 0, F.when(tenure <= 6, flag("red", "High turnover — avg tenant ~%.0f mo", tenure)).when(tenure <= 9, flag("yellow", "Short tenure — avg tenant ~%.0f mo", tenure)).when(tenure >= 24, flag("green", "Stable tenants — avg stay ~%.0f mo", tenure)))
        .when(relists >= 3, flag("red", "Relisted %d times — possible issues", _int(relists))).when(relists == 2, flag("yellow", "Relisted twice")),
        "shelter": F.when((n("shelter_count") >= 3) & (shelter_m <= 200), flag("red", "%d homeless facilities within 800m (nearest: %dm)", i("shelter_count"), shelter_m)).when((n("shelter_count") >= 1) & (shelter_m <= 150), flag("yellow", "%s %dm away", label("shelter_nearest_name", "Homeless facility"), shelter_m)),
        "projects": F.when((n("project_count") >= 10) & (project_m <= 200), flag("red", "%d NYCHA buildings within 800m (nearest: %dm)", i("project_count"), project_m)).when((n("project_count") >= 5) & (project_m <= 300), flag("yellow", "%s — %d bldgs nearby", label("project_nearest_name", "NYCHA project"), i("project_count"))),
        "pest": F.when(known("pest_hpd_count", "pest_rodent_count"), F.when(hpd + rodent == 0, flag("green", "No pest or rodent complaints")).when(
            p_units >= 50, F.when(per_pest >= 0.05, flag("red", "%d HPD pest complaints (%.1f%% of units)", _int(hpd), per_pest * 100)).when(per_pest >= 0.02, flag("yellow", "Some pest activity (%d building, %d area)", *area)).when(rodent >= 10, flag("yellow", "%d rodent complaints in area", _int(rodent)))
        ).when(hpd >= 5, flag("red", "%d HPD pest complaints in building", _int(hpd))).when(hpd + rodent >= 10, flag("red", "High pest activity (%d building, %d area)", *area)).when(hpd + rodent >= 3, flag("yellow", "Some pest activity (%d building, %d area)", *area))),
        "highway_adjacent": F.when(r.road_exposure_hwy_dist_m <= 150, flag("red", "~%dm from a highway — expect constant traffic noise", _int(F.rint(r.road_exposure_hwy_dist_m)))),
        "truck_route": F.when(r.road_exposure_truck >= 1.5, flag("yellow", "On or beside a designated truck route")),
    }


def listing_flags(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, flags): an array of (rule, type, text) for each row, in the order of the rules."""
    found = rules(Row(df))
    item = lambda name, f: F.when(f.isNotNull(), F.struct(F.lit(name).alias("rule"), f["type"].alias("type"), f["text"].alias("text")))
    return df.select(key, F.array_compact(F.array(*(item(n, f) for n, f in found.items()))).alias("flags"))


def record_flags(facts: DataFrame, key: str = "bbl") -> DataFrame:
    """(key, flags) of the structs that records.assemble gives."""
    f = lambda topic, name: F.col(f"{topic}.{name}")
    have = {k for k, t in facts.dtypes if t.startswith("struct")}
    v = lambda topic, column: column if topic in have else F.lit(None)
    owed, age = lambda: F.coalesce(f("penalties", "balance_due"), F.lit(0.0)), lambda: F.coalesce(f("shed", "age_days"), F.lit(0))
    each = {
        "vacate": lambda: F.when(f("vacate", "has_active"), flag("red", "Active HPD vacate order on this building (%s)", F.lower(F.coalesce(f("vacate", "reason"), F.lit("unsafe conditions"))))),
        "enforcement": lambda: F.when(f("enforcement", "in_program"), flag("red", "On HPD's Alternative Enforcement list (city-designated worst buildings)")),
        "bedbugs": lambda: F.when(f("bedbugs", "total_reinfested") > 0, flag("red", "Repeat bedbug infestations reported by owner")).when(f("bedbugs", "total_infested") > 0, flag("yellow", "%d unit(s) reported bedbug infestation", _int(f("bedbugs", "total_infested")))).when(f("bedbugs", "filings") >= 2, flag("green", "Owner bedbug filings on record — no infestations reported")),
        "speculation": lambda: F.when(f("speculation", "on_list"), flag("yellow", "Building on NYC Speculation Watch List (recent investor purchase)")),
        "liens": lambda: F.when(f("liens", "entry_count") > 0, F.when(f("liens", "all_water"), flag("yellow", "Building appeared on tax-lien sale list (water debt)")).otherwise(flag("red", "Building appeared on tax-lien sale list (financial distress)"))),
        "shed": lambda: F.when(f("shed", "has_active"), F.when(age() > 730, flag("yellow", "Sidewalk shed up for %d+ years (facade work stalled?)", _int(F.floor(age() / 365)))).otherwise(flag("yellow", "Active sidewalk shed / scaffolding at building"))),
        "penalties": lambda: F.when(owed() > 10_000, flag("red", "$%,d in unpaid DOB/ECB penalties", _int(owed()))),
        "repairs": lambda: F.when(f("repairs", "order_count") >= 3, flag("red", "%d city emergency-repair orders (owner failed to fix)", _int(f("repairs", "order_count")))),
        "registration": lambda: F.when(f("registration", "expired"), flag("yellow", "Landlord's HPD registration has expired")),
    }
    item = lambda name, c: F.when(c.isNotNull(), F.struct(F.lit(name).alias("rule"), c["type"].alias("type"), c["text"].alias("text")))
    return facts.select(key, F.array_compact(F.array(*(item(n, v(n, make())) for n, make in each.items() if n in have))).alias("flags"))


def dealbreaker_chips(flags: Column, triggers: Column, ignore: frozenset[str] = frozenset()) -> Column:
    """flags with one red flag for each dimension that triggers the dealbreaker and isn't ignored."""
    kept = F.filter(triggers, lambda t: ~t.isin(*ignore)) if ignore else triggers
    text = lambda t: F.concat(F.lit("Dealbreaker: "), F.replace(t, F.lit("_"), F.lit(" ")), F.lit(" is in the bottom tier citywide (caps overall score)"))
    chip = lambda t: F.struct(F.concat(F.lit("dealbreaker_"), t).alias("rule"), F.lit("red").alias("type"), text(t).alias("text"))
    return F.concat(flags, F.transform(kept, chip))
