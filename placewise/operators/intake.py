"""Reports and sign-ups coming in: validation, rate limits, and the sponsor list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T
from ..functions.contact import site_address
from ..functions.geo import in_box
from ..session import cut_lineage
from . import limits
from .limits import DAY_US, address_start, address_step, mail_start, mail_step, report_start, report_step, visitor_start, visitor_step
from .serial import decided_in_slices
from .status import at


# ------------------------------------------------------------------------------- validation
def is_bot(trap: Column, rendered_at: Column, submitted_at: Column) -> Column:
    """The hidden field was filled in, or the form was sent too fast or too late."""
    age = (F.unix_micros(submitted_at) - F.unix_micros(rendered_at)) / F.lit(1e6)
    fair = age.between(V.FORM_MIN_SECONDS, V.FORM_MAX_SECONDS)
    return (F.coalesce(trap, F.lit("")) != "") | ~F.coalesce(fair, F.lit(False))


def check_reports(forms: DataFrame, as_of) -> DataFrame:
    """Adds ``reason`` (NULL when fine) and the cleaned fields to raw report forms.

    ``forms``: provider, status, scope, visit_date, note, insurers (array), site: all as typed.
    """
    now, c = at(as_of), lambda n: T.strip(F.coalesce(F.col(n), F.lit("")))
    provider = c("provider").try_cast("bigint")
    scope = F.coalesce(F.nullif(c("scope"), F.lit("")), F.lit("all"))
    noon = F.try_to_timestamp(F.concat(c("visit_date"), F.lit(" 12:00:00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    age = (F.unix_micros(now) - F.unix_micros("noon")) / F.lit(float(DAY_US))
    reason = (
        F.when(F.col("provider_id").isNull() | (F.col("provider_id") <= 0), "provider")
        .when(~c("status").isin(V.STATUSES), "status")
        .when(~F.col("scope_ok").isin(V.SCOPES), "scope")
        .when(~c("visit_date").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.col("noon").isNull(), "date")
        .when((age < -1) | (age > V.REPORT_MAX_AGE_DAYS), "age")
    )
    note = F.nullif(F.substring(F.regexp_replace(c("note"), r"\s+", " "), 1, V.NOTE_CHARS), F.lit(""))
    codes = F.array(*[F.lit(x) for x in V.INSURER_NAMES])
    return (
        forms.withColumns({"provider_id": provider, "scope_ok": scope, "noon": noon})
        .withColumns(
            {
                "reason": reason, "observed_at": F.least("noon", now), "note": note,
                "insurers": F.array_intersect(F.array_distinct("insurers"), codes), "site": site_address(F.col("site")),
            }
        )
        .withColumn("scope", F.col("scope_ok"))
        .drop("noon", "scope_ok")
    )


def check_signups(forms: DataFrame) -> DataFrame:
    """Adds ``ok`` and the cleaned fields to raw sign-up forms."""
    c = lambda n: T.strip(F.coalesce(F.col(n), F.lit("")))
    known = [slug for slug, _, _ in V.SPECIALTIES]
    cleaned = forms.withColumns(
        {
            "email": F.lower(c("email")), "lat": c("lat").try_cast("double"), "lng": c("lng").try_cast("double"),
            "radius_km": c("radius_km").try_cast("int"),
            "place": F.substring(F.regexp_replace(c("place"), r"\s+", " "), 1, 80),
            "lang": F.when(F.col("lang") == "en", "en").otherwise("cs"),
        }
    )
    ok = (
        F.col("specialty").isin(known) & (F.length("email") <= 254) & F.col("email").rlike(V.SIGNUP_EMAIL)
        & in_box(F.col("lat"), F.col("lng"), V.BOX_SIGNUP) & (F.col("place") != "") & F.col("radius_km").isin(V.SIGNUP_RADII)
    )
    return cleaned.withColumn("ok", F.coalesce(ok, F.lit(False)))


# ------------------------------------------------------------------------------- rate limits
def limit_reports(reports: DataFrame, providers: DataFrame, slices: int | None = None) -> DataFrame:
    """(report_id, result): ok, duplicate, too_many or no_provider.

    Only accepted reports count against the limits, so each decision needs the ones before it. A reporter's stream is cut
    into slices that are decided in parallel; at most ten accepted reports go from a slice to the next.
    """
    open_ = providers.filter("active").select("provider_id", F.lit(True).alias("open"))
    known = reports.select("report_id", "reporter", "provider_id", F.unix_micros("created_at").alias("ts_us")).join(
        open_, "provider_id", "left"
    )
    nobody = known.filter(F.col("open").isNull()).select("report_id", F.lit("no_provider").alias("result"))
    decided = decided_in_slices(
        known.filter("open").select("report_id", F.coalesce("reporter", F.lit("")).alias("reporter"), "provider_id", "ts_us"),
        "reporter", "ts_us", ["report_id"], report_step, report_start, ["provider_id"], F.col("result") == "ok", DAY_US, slices,
    )
    return decided.select("report_id", "result").unionByName(nobody)


HOUR_US = 3_600_000_000


def logged_before(requests: DataFrame, mails: DataFrame) -> DataFrame:
    """(id, logged): how many ``mails`` (ts_us) there were in the 24 hours up to each request (id, ts_us).

    The difference of two running counts, each made of the hours before and the rows of its own hour.
    """
    sides = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("ts_us")), F.struct(F.lit(-1).alias("sign"), (F.col("ts_us") - DAY_US).alias("ts_us"))))
    asked = requests.select("id", sides.alias("s")).select("id", "s.*")
    points = mails.select("ts_us", F.lit(1).alias("mail")).unionByName(asked, allowMissingColumns=True)
    points = points.withColumns({"hour": F.floor(F.col("ts_us") / HOUR_US), "mail": F.coalesce("mail", F.lit(0))})
    hours = points.groupBy("hour").agg(F.sum("mail").alias("n"))  # as long as the time is, not the log
    hours = hours.select("hour", F.coalesce(F.sum("n").over(W.orderBy("hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    own = F.sum("mail").over(W.partitionBy("hour").orderBy("ts_us").rangeBetween(W.unboundedPreceding, W.currentRow))
    counted = points.withColumn("own", own).filter("sign is not null").join(hours, "hour")
    return counted.groupBy("id").agg(F.sum(F.col("sign") * (F.col("earlier") + F.col("own"))).alias("logged"))


def _without_open(rows: DataFrame) -> DataFrame:
    """(id, verified): the requests of addresses that send nothing, and whether a confirmed subscription is there already."""
    given = rows.filter("kind = 0").select("email", "where", F.struct("ts_us", "id").alias("made"), "verified", "ended")
    mine = rows.filter("kind = 1").select("email", "where", "id", "ts_us")
    same = (
        mine.join(given, ["email", "where"])
        .filter((F.col("made.ts_us") <= F.col("ts_us")) & ((F.col("ended") < 0) | (F.col("ended") > F.col("ts_us"))))
        .groupBy("id", "ts_us").agg(F.min_by("verified", "made").alias("at"))
    )
    return mine.select("id").join(same.select("id", F.col("at").between(F.lit(0), F.col("ts_us")).alias("verified")), "id", "left")


def limit_signups(requests: DataFrame, subs: DataFrame, mail_log: DataFrame, slices: int | None = None) -> DataFrame:
    """(request_id, result): send, already or too_many, as if all requests were decided one after the other.

    Three limits depend on each other's decisions: three confirmations a day and ten subscriptions for an address, five
    subscriptions a day for a visitor, and the mails of a day for everyone. Each is decided in order over its own key, given
    the refusals of the other two from the round before, until no refusal changes. The first request in time is
    right in the first round and every next one a round after those before it, so what does not change is the serial result.

    Requests that come when the mail log alone fills the day send nothing, whatever the others do: they are closed from the
    start, and addresses with closed requests only are decided by one join. Only the others go through the rounds.
    """
    us = lambda c: F.coalesce(F.unix_micros(c), F.lit(-1))
    place = F.concat_ws("/", "specialty", F.col("radius_km").cast("long").cast("string"), *[F.format_string("%.3f", F.round(c, 3)) for c in ("lat", "lng")])
    none = F.lit(-1).cast("long")
    own = lambda df, kind, number, sends, verified, ended: df.select(
        F.coalesce(F.lower("email"), F.lit("")).alias("email"), us("created_at").alias("ts_us"), F.lit(kind).alias("kind"), F.col(number).alias("id"),
        F.coalesce("requester", F.lit("")).alias("requester"), place.alias("where"), sends.alias("sends"), verified.alias("verified"), ended.alias("ended"))
    old = own(
        subs.withColumnsRenamed({"specialty_slug": "specialty", "requester_hash": "requester"}), 0, "subscription_id",
        F.col("confirm_sends").cast("long"), us("verified_at"), us("unsubscribed_at"))
    new = own(requests, 1, "request_id", none, none, none)
    logged = logged_before(new.select("id", "ts_us"), mail_log.filter(F.col("sent_at").isNotNull()).select(us("sent_at").alias("ts_us")))
    new = cut_lineage(new.join(logged, "id").withColumn("closed", F.col("logged") >= limits.DAILY_MAILS))
    live = new.filter("not closed").select("email").distinct()
    everything = old.unionByName(new, allowMissingColumns=True)
    quiet = _without_open(everything.join(live, "email", "left_anti"))
    settled = quiet.select(F.col("id").alias("request_id"), F.when(F.col("verified"), "already").otherwise("too_many").alias("result"))
    if live.isEmpty():
        return settled
    fields = F.to_json(F.struct("requester", "where", "sends", "verified", "ended"))
    rows = everything.join(live, "email", "left_semi").withColumns({"fields": fields, "closed": F.coalesce("closed", F.lit(False)), "logged": F.coalesce("logged", F.lit(0))})
    rows = cut_lineage(rows.drop("where", "sends", "verified", "ended"))
    # subscriptions of the visitors whose requests are open, of whatever address
    signed = old.select("requester", "ts_us", "kind", "id", F.concat(F.lit("s"), F.col("id").cast("string")).alias("sub"))
    signed = cut_lineage(signed.join(new.filter("not closed").select("requester").distinct(), "requester", "left_semi"))
    empty = rows.filter("false").select("id", F.lit(True).alias("refused"), F.lit(True).alias("no_mail"))
    refusals = empty
    while True:
        asked = rows.join(refusals.withColumn("kind", F.lit(1)), ["kind", "id"], "left").withColumns(
            {"blocked": F.col("closed") | F.coalesce("refused", F.lit(False)), "no_mail": F.coalesce("no_mail", F.lit(False))}).drop("refused")
        counts = F.col("result").startswith("send") | (F.col("kind") == 0)
        # an address has ten subscriptions at most, so all its accepted requests go along
        at_address = cut_lineage(decided_in_slices(
            asked, "email", "ts_us", ["kind", "id"], address_step, address_start, ["kind", "id", "fields"], counts, 1 << 62, slices).filter("kind = 1"))
        parts = F.split("result", r"\|")
        open_ = at_address.filter(~F.col("result").isin("verified", "full") & ~F.col("closed")).select(
            "requester", "ts_us", "id", "no_mail", "blocked", "logged", F.get(parts, F.lit(0)).alias("said"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("sub"),
            F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("owner")).withColumn("due", F.col("said") != "ask")
        renewed = open_.filter("said = 'send' and owner <> requester").select(F.col("owner").alias("requester"), "ts_us", F.lit(1).alias("kind"), "id", "sub")
        mine = open_.select("requester", "ts_us", F.lit(2).alias("kind"), "id", "sub", "owner", "due", "no_mail", "logged")
        events = mine.unionByName(signed.unionByName(renewed), allowMissingColumns=True).fillna({"due": False, "no_mail": False, "owner": ""})
        of_visitor = cut_lineage(decided_in_slices(
            events, "requester", "ts_us", ["kind", "id"], visitor_step, visitor_start, ["sub"], F.col("result").isin("given", "kept"), DAY_US, slices
        ).filter("kind = 2").select("id", "ts_us", "due", "logged", (F.col("result") == "full").alias("refused")))
        mails = of_visitor.filter("not refused").select("ts_us", "id", "due", "logged")
        of_mails = decided_in_slices(
            mails.withColumn("all", F.lit("")), "all", "ts_us", ["id"], mail_step, mail_start, ["id"], F.col("result") == "kept", DAY_US, slices
        ).select("id", (F.col("result") == "full").alias("no_mail"))
        judged = of_visitor.join(of_mails, "id", "left").select("id", (F.col("refused") | F.coalesce("no_mail", F.lit(False))).alias("refused"), F.coalesce("no_mail", F.lit(False)).alias("no_mail"))
        new = cut_lineage(judged.join(open_.select("id", "blocked", F.col("no_mail").alias("was")), "id"))
        if new.filter("refused <> blocked or no_mail <> was").isEmpty():
            break
        refusals = new.select("id", "refused", "no_mail")
    said, blocked = F.col("result"), F.col("blocked")
    result = (
        F.when(said == "verified", "already").when(said == "full", "too_many").when(blocked, "too_many").when(said == "ask", "already").otherwise("send")
    )
    return at_address.select(F.col("id").alias("request_id"), result.alias("result")).unionByName(settled)


# ------------------------------------------------------------------------------- sponsors
def add_listings(listings: DataFrame, orders: DataFrame, providers: DataFrame, as_of) -> DataFrame:
    """New listings: town from the practice and start today unless given; unknown practices are left out."""
    today = F.to_date(at(as_of))
    new = orders.join(providers.select("provider_id", F.col("city_slug").alias("own_town")), "provider_id").select(
        "listing_id", "provider_id", "specialty_slug", F.coalesce("city_slug", "own_town").alias("city_slug"), "tagline",
        F.coalesce("starts_on", today).alias("starts_on"), "ends_on",
    )
    return listings.select(*new.columns).unionByName(new)


def running_listings(listings: DataFrame, as_of) -> DataFrame:
    """Not ended yet, the next to end first."""
    return listings.filter(F.col("ends_on") >= F.to_date(at(as_of))).orderBy("ends_on", "listing_id")


def end_listings(listings: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Ended as of yesterday; one that had not begun begins no later than it ends."""
    yesterday = F.date_sub(F.to_date(at(as_of)), 1)
    stop = F.col("stopped").isNotNull()
    return (
        listings.join(ids.select("listing_id", F.lit(True).alias("stopped")), "listing_id", "left")
        .withColumns(
            {
                "starts_on": F.when(stop, F.least("starts_on", yesterday)).otherwise(F.col("starts_on")),
                "ends_on": F.when(stop, yesterday).otherwise(F.col("ends_on")),
            }
        )
        .drop("stopped")
    )


def merge_user_flags(flags: DataFrame, reported: DataFrame) -> DataFrame:
    """Visitors' facts added to the table; the newer observation of a fact stays."""
    cols = ["provider_id", "flag", "source", "observed_at"]
    new = reported.withColumn("source", F.lit("user")).select(*cols)
    return flags.select(*cols).unionByName(new).groupBy("provider_id", "flag", "source").agg(F.max("observed_at").alias("observed_at"))
