"""Notification plans (M1-M10): the send list as a DataFrame.

Delivery (the push API) is outside the engine; a plan row says who gets
which message and whether the quota allows it. Delivery failures are an
input of ``log_attempts``, not computed here.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.functions.exprs import CHANGE_ICONS, RANK_ICONS, format_volume, icon_lookup, ntz, row_uuid
from liftlake.operators.joins import broadcast_if_bounded
from liftlake.operators.ordered import positions
from liftlake.operators.quota import gate, limit_for, monthly_sent_count, zone_period_start_utc

# Message templates ({app_url} is the deployment's link).
MSG_3DAY = "⚠️ {days}日間トレーニングしていません！\n\n💪 今日もトレーニングしましょう！\n📱 アプリを開く: {app_url}"
MSG_7DAY = "⚠️ 「{part}」のトレーニングが7日以上空いています！\n最後の{part}トレ: {last}\n\n📱 アプリを開く: {app_url}"
MSG_START = "🏋️ {name}がトレーニングを開始しました！\n今日のメニュー: {part}\n\n📱 アプリを開く: {app_url}"
HEAD_WEEKLY = "🏆 週間ランキング（{start}〜{end}）\n"
HEAD_MONTHLY = "🏆 月間ランキング（{month}）\n"
FOOTER = "\n📱 詳細を見る: {app_url}"
PREV_RANK = "(前回{prev}位)"
RANK_SUFFIX = "位"

PLAN_COLUMNS = ["user_id", "line_user_id", "notification_type", "status", "position", "message"]


def _fmt(template: str, **cols) -> F.Column:
    """Fill a ``{name}`` template with columns (string pieces concatenated)."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = cols[m.group(1)]
        parts.append(v if isinstance(v, F.Column) else F.lit(str(v)))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def sent_count_value(log: DataFrame, now: _dt.datetime) -> int:
    return int(monthly_sent_count(log, now).first()["cnt"])


def three_day_candidates(last_training: DataFrame, users: DataFrame) -> DataFrame:
    """M3: DISTINCT user, push address, name, days since any training."""
    u = broadcast_if_bounded(users.select("user_id", "line_user_id", "user_name"))
    return (last_training.where(F.col("needs_3day_reminder"))
            .select("user_id", "days_since_last_any").join(u, "user_id", "inner")
            .select("user_id", "line_user_id", "user_name", "days_since_last_any").distinct())


def seven_day_candidates(last_training: DataFrame, users: DataFrame) -> DataFrame:
    """M4: user, push address, body part and its last date."""
    u = broadcast_if_bounded(users.select("user_id", "line_user_id"))
    return (last_training.where(F.col("needs_7day_reminder"))
            .select("user_id", "body_part_name", "last_training_date").join(u, "user_id", "inner")
            .select("user_id", "line_user_id", "body_part_name", "last_training_date"))


def _addressed(candidates: DataFrame) -> DataFrame:
    """Candidates with a push address (NULL where the caller has none)."""
    if "line_user_id" in candidates.columns:
        return candidates
    return candidates.withColumn("line_user_id", F.lit(None).cast("string"))


def daily_plan(three: DataFrame, seven: DataFrame, base_count: int, app_url: str = "") -> DataFrame:
    """M5: 3-day reminders then 7-day reminders under the monthly quota.

    Closed under the original loop: nothing at all if the 3-day gate is shut
    at the start; 3-day rows sent while base + sent < 190; the 7-day block
    runs only if base + sent3 < 180, its rows sent while the running count
    stays below 180. Candidate order: user (then body part)."""
    empty = three.sparkSession.createDataFrame(
        [], "user_id string, line_user_id string, notification_type string, status string, position bigint, message string")
    three, seven = _addressed(three), _addressed(seven)
    if base_count >= limit_for("3day"):
        return empty
    allow3 = limit_for("3day") - base_count
    n3 = three.count()
    sent3 = min(n3, allow3)
    p3 = gate(three, [F.col("user_id").asc(), F.col("days_since_last_any").asc()], allow3, "3day",
              keys=["user_id", "days_since_last_any"])
    p3 = p3.withColumn("message", _fmt(MSG_3DAY, days=F.col("days_since_last_any").cast("string"),
                                       app_url=app_url))
    plan = p3.select(*PLAN_COLUMNS)
    count = base_count + sent3
    if count < limit_for("7day"):
        allow7 = limit_for("7day") - count
        p7 = gate(seven, [F.col("user_id").asc(), F.col("body_part_name").asc_nulls_first()], allow7, "7day",
                  keys=["user_id", "body_part_name"])
        p7 = p7.withColumn("message", _fmt(MSG_7DAY, part=F.coalesce(F.col("body_part_name"), F.lit("None")),
                                           last=F.col("last_training_date").cast("string"), app_url=app_url))
        plan = plan.unionByName(p7.select(*PLAN_COLUMNS))
    return plan


def latest_period(ranking: DataFrame, period_col: str) -> DataFrame:
    """Rows of the newest period (scalar subquery as a broadcast join of
    the one-row maximum)."""
    mx = ranking.agg(F.max(period_col).alias("_mx"))
    return ranking.join(F.broadcast(mx), F.col(period_col) == F.col("_mx"), "inner").drop("_mx")


def digest_lines(ranking: DataFrame, users: DataFrame, kind: str = "weekly", app_url: str = "") -> DataFrame:
    """M6: the ranking message of the newest period as ordered lines
    (section 0 header, 1 one line per ranked user, 2 footer); no rows when
    the ranking is empty. Lines stay distributed; the message is their
    concatenation in (section, rank, user_id) order (see ``digest_chunks``)."""
    period = "week_start" if kind == "weekly" else "month"
    latest = latest_period(ranking, period)
    u = broadcast_if_bounded(users.select("user_id"))
    rows = latest.join(u, "user_id", "inner")
    icon = icon_lookup("rank", RANK_ICONS, F.concat(F.col("rank").cast("string"), F.lit(RANK_SUFFIX)))
    change = icon_lookup("rank_change", CHANGE_ICONS, "")
    prev = F.when(F.col("prev_rank").isNotNull() & (F.col("prev_rank") != 0),
                  _fmt(PREV_RANK, prev=F.col("prev_rank").cast("string"))).otherwise(F.lit(""))
    line = F.concat(icon, F.lit(" "), F.coalesce(F.col("user_name"), F.lit("None")), F.lit(": "),
                    format_volume("total_volume"), F.lit(" kg  "), change, F.lit(" "), prev)
    body = rows.select(F.lit(1).alias("section"), F.col("rank"), F.col("user_id"), line.alias("text"))
    if kind == "weekly":
        head_text = _fmt(HEAD_WEEKLY, start=F.col(period).cast("string"),
                         end=F.date_add(F.col(period), 6).cast("string"))
    else:
        head_text = _fmt(HEAD_MONTHLY, month=F.date_format(F.col(period), "yyyy年MM月"))
    first = rows.select(period).distinct()
    head = first.select(F.lit(0).alias("section"), F.lit(None).cast("bigint").alias("rank"),
                        F.lit(None).cast("string").alias("user_id"), head_text.alias("text"))
    foot = first.select(F.lit(2).alias("section"), F.lit(None).cast("bigint").alias("rank"),
                        F.lit(None).cast("string").alias("user_id"),
                        F.lit(FOOTER.format(app_url=app_url)).alias("text"))
    return head.unionByName(body).unionByName(foot)


# Lines of a digest that one chunk of its text holds.
CHUNK_LINES = 100


def digest_chunks(lines: DataFrame, digest: str) -> DataFrame:
    """The digest's text as numbered chunks (digest, chunk, text): the chunks in
    order, joined by line ends, are the message. Lines get their places by
    (section, rank, user) over sampled ranges, so no task holds them all."""
    order = [F.asc("section"), F.asc(F.coalesce("rank", F.lit(0))), F.asc("user_id")]
    placed = positions(lines, order, "_line")
    piece = F.struct("_line", "text")
    return (placed.groupBy(F.floor((F.col("_line") - 1) / CHUNK_LINES).cast("bigint").alias("chunk"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "\n").alias("text"))
            .select(F.lit(digest).alias("digest"), "chunk", "text"))


def render_message(lines: DataFrame) -> str | None:
    """The digest's text for a delivery, chunk by chunk; None without lines."""
    found = [r["text"] for r in digest_chunks(lines, "").orderBy("chunk").toLocalIterator()]
    return "\n".join(found) if found else None


def digest_plan(digest: str | None, users: DataFrame, base_count: int, notification_type: str) -> DataFrame:
    """M7: every active user gets the digest, gated per row at 200; no rows
    without a digest (None). Rows name the digest; :func:`digest_messages` gives
    each its text, :func:`digest_deliveries` the chunks of those that are sent."""
    columns = [c for c in PLAN_COLUMNS if c != "message"]
    if digest is None:
        return users.sparkSession.createDataFrame(
            [], "user_id string, line_user_id string, notification_type string, status string, position bigint, digest string")
    allow = limit_for(notification_type) - base_count
    p = gate(_addressed(users).select("user_id", "line_user_id"), [F.col("user_id").asc()], allow, notification_type, keys=["user_id"])
    return p.select(*columns, F.lit(digest).alias("digest"))


def digest_messages(plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """The plan with the whole message of its digest on every row, sent or
    suppressed. A digest is one text, so the texts (a row for each digest, put
    together from the chunks) are the broadcast side. Plan rows are short and
    would come in one task, which then wrote every row's text: they are dealt to
    as many as a shuffle has."""
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece = F.struct("chunk", "text")
    texts = chunks.groupBy("digest").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "\n").alias("message"))
    return plan.repartition(tasks).join(F.broadcast(texts), "digest").select(*PLAN_COLUMNS, "digest")


def digest_deliveries(plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """What is sent: a row for each sent plan row and chunk of its digest. At
    most the quota's 200 rows are sent, so they are the broadcast side."""
    sent = plan.where(F.col("status") == "sent").select("user_id", "line_user_id", "position", "digest")
    return chunks.join(F.broadcast(sent), "digest").select("user_id", "line_user_id", "position", "digest", "chunk", "text")


def digest_name(lines: DataFrame, ranking: DataFrame, period: str, notification_type: str) -> str | None:
    """``type:newest period`` if the digest has lines, else None."""
    newest = ranking.agg(F.max(period).cast("string").alias("p")).first()["p"]
    return None if newest is None or lines.isEmpty() else f"{notification_type}:{newest}"


def start_plan(log: DataFrame, users: DataFrame, sender: str, body_part: str, now: _dt.datetime,
               base_count: int | None = None, check_column: str = "user_id", app_url: str = ""):
    """M8: training-start notice to every other active user, once per Tokyo
    day. Returns (status, plan): already_sent (no plan), suppressed (one
    suppressed row for the sender), error (unknown sender), completed.

    The "already sent today" test looks at log rows whose ``check_column``
    is the sender (the original writes rows for recipients, so by default
    this finds notices the sender *received*). The quota is checked once
    for the whole batch, not per recipient."""
    spark = log.sparkSession
    schema = "user_id string, notification_type string, status string, position bigint, message string"
    day_start = zone_period_start_utc(now, "day")
    done = (log.where((F.col(check_column) == sender) & (F.col("notification_type") == "start")
                      & (F.col("status") == "sent")
                      & (F.col("sent_at") >= ntz(day_start))).limit(1).count())
    if done > 0:
        return "already_sent", spark.createDataFrame([], schema)
    if base_count is None:
        base_count = sent_count_value(log, now)
    if base_count >= limit_for("start"):
        return "suppressed", spark.createDataFrame([(sender, "start", "suppressed", None, None)], schema)
    me = users.where(F.col("user_id") == sender).select("user_name").limit(1).collect()
    if not me:
        return "error", spark.createDataFrame([], schema)
    msg = _fmt(MSG_START, name=me[0]["user_name"], part=body_part, app_url=app_url)
    others = users.where(F.col("user_id") != sender).select("user_id")
    plan = others.select("user_id", F.lit("start").alias("notification_type"), F.lit("sent").alias("status"),
                         F.lit(None).cast("bigint").alias("position"), msg.alias("message"))
    return "completed", plan


def log_attempts(plan: DataFrame, now: _dt.datetime, failed: DataFrame | None = None) -> DataFrame:
    """M9: notification_log rows for a plan; ``failed`` (user_id,
    notification_type) marks delivery failures."""
    p = plan
    if failed is not None:
        f = broadcast_if_bounded(failed.select("user_id", "notification_type").distinct()
                                 .withColumn("_failed", F.lit(True)))
        p = p.join(f, ["user_id", "notification_type"], "left")
        p = p.withColumn("status", F.when(F.coalesce(F.col("_failed"), F.lit(False)) & (F.col("status") == "sent"),
                                          F.lit("failed")).otherwise(F.col("status")))
    return p.select(row_uuid().alias("notification_id"), "user_id", "notification_type", "status",
                    ntz(now).alias("sent_at"))


def merge_same_day(plan: DataFrame) -> DataFrame:
    """M10 (documented plan): one notice per user combining the day's
    reminder messages (bounded: at most one 3-day and six 7-day notices)."""
    sent = plan.where(F.col("status") == "sent")
    return sent.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_list("message")), "\n\n").alias("message"),
        F.count(F.lit(1)).alias("merged"))
