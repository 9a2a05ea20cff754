"""Raw logs to typed rows, with column expressions only.

No join is needed to decode: the topic decides which words are read, and all
branches of one family are evaluated in a single narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as reg
from ..functions import evm, u256

LOG_FIELDS = ("chain_id", "tx_hash", "block_number", "log_index", "removed")


def _topic(i: int) -> Column:
    """topics[i] or NULL."""
    return F.get(F.col("topics"), F.lit(i))


def _extra(logs: DataFrame, extra) -> list[str]:
    return [c for c in extra if c in logs.columns]


def with_topic0(logs: DataFrame) -> DataFrame:
    """Adds the pushed-down topic column to logs that only carry the array."""
    return logs if "topic0" in logs.columns else logs.withColumn("topic0", F.lower(_topic(0)))


def classify_logs(logs: DataFrame, registry: DataFrame, on_unknown: str = "skip") -> DataFrame:
    """Attach family and event name by topic.

    ``skip`` drops unknown topics, ``unknown`` keeps them as ``Unknown``, and
    ``fail`` makes the job fail on the first one.
    """
    names = F.broadcast(registry.select("topic0", "family", "event_name"))  # one row per event
    if on_unknown == "skip":
        return with_topic0(logs).join(names, "topic0")
    joined = with_topic0(logs).join(names, "topic0", "left")
    if on_unknown == "unknown":
        return joined.withColumn("event_name", F.coalesce("event_name", F.lit("Unknown")))
    if on_unknown == "fail":
        problem = F.concat(F.lit("unknown event topic "), F.coalesce("topic0", F.lit("(none)")))
        return joined.withColumn("event_name", F.coalesce("event_name", F.raise_error(problem)))
    raise ValueError(f"unknown policy {on_unknown!r}")


def decode_by_registry(logs: DataFrame, registry: DataFrame, extra=("block_timestamp",)) -> DataFrame:
    """Any declared event as (event_name, ``fields``): the registry's rows alone say how.

    ``fields`` maps each declared field to its text: addresses and fixed bytes in lower-case
    hex, numbers in decimal (``int`` types signed), ``bool`` as true or false, ``string`` and
    ``bytes`` from the place their word points to (text, hex). A field whose word is missing
    or malformed is null. Indexed ``string`` and ``bytes`` are their hash. Logs of other topics are left
    out. A registry of at most ``SMALL_REGISTRY`` rows is sent to the tasks, a larger one joined.
    """
    rules = registry.select("topic0", "family", "event_name", "indexed", F.col("data").alias("_slots"))
    if rules.limit(SMALL_REGISTRY + 1).count() <= SMALL_REGISTRY:
        rules = F.broadcast(rules)
    plain = F.lower(F.regexp_replace("data", "^0[xX]", ""))
    rows = with_topic0(logs).join(rules, "topic0").withColumn("_plain", plain)
    topic = lambda i: F.lower(F.substr(F.get(F.col("topics"), i + 1), F.lit(3)))
    word = lambda i: F.substr(F.col("_plain"), i * 64 + 1, F.lit(64))
    named = lambda slots, value: F.transform(
        slots, lambda s, i: F.struct(s["field"].alias("key"), value(s["type"], i).alias("value"))
    )
    every = F.concat(
        named(F.col("indexed"), lambda t, i: _slot_text(t, topic(i), None)),
        named(F.col("_slots"), lambda t, i: _slot_text(t, word(i), F.col("_plain"))),
    )
    return rows.select(
        "chain_id", F.col("address").alias("contract_address"), "family", "event_name", F.map_from_entries(every).alias("fields"),
        *[c for c in LOG_FIELDS if c != "chain_id"], *_extra(logs, extra),
    )


SMALL_REGISTRY = 10_000


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside a lambda every mention would be computed again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_SHORT = 15  # hex digits that a long holds


def _number_text(word: Column, signed: Column) -> Column:
    """Decimal text of a whole word; one that fits a long never becomes a decimal number."""
    low = lambda w: F.conv(F.right(w, F.lit(_SHORT)), 16, 10)
    flip = lambda w: F.translate(w, "0123456789abcdef", "fedcba9876543210")
    one_more = lambda n: u256.normalise_parts(n["hi"], n["mid"], (n["lo"].cast(u256.WIDE) + 1).cast(u256.WIDE))
    minus = lambda text: F.concat(F.lit("-"), text)
    negative = signed & (F.substring(word, 1, 1) >= "8")
    return (
        F.when(word.startswith("0" * (64 - _SHORT)), low(word))
        .when(negative & word.startswith("f" * (64 - _SHORT)), minus((low(flip(word)).cast("long") + 1).cast("string")))
        .when(negative, minus(_once(u256.from_hex(flip(word)), lambda n: _once(one_more(n), u256.to_string))))
        .otherwise(_once(u256.from_hex(word), u256.to_string))
    )


def _slot_text(kind: Column, word: Column, data: Column | None) -> Column:
    """Text of one declared slot; ``data`` holds what dynamic types point into."""
    place = lambda w: F.when(w.rlike("^0{49}[0-9a-f]{15}$"), F.conv(F.right(w, F.lit(15)), 16, 10).cast("long"))

    def pointed(at: Column, length: Column) -> Column:
        fits = (at <= 1 << 29) & ((at + 32 + length) * 2 <= F.length(data))
        body = F.when(fits, F.substr(data, ((at + 32) * 2 + 1).cast("int"), (length * 2).cast("int")))
        return F.when(kind == "string", F.decode(F.unhex(body), "UTF-8")).otherwise(F.concat(F.lit("0x"), body))

    def text(word: Column) -> Column:
        size = F.when(kind.rlike("^bytes[0-9]+$"), F.regexp_extract(kind, "[0-9]+", 0).cast("int"))
        if data is None:
            dynamic = F.concat(F.lit("0x"), word)
        else:
            dynamic = _once(place(word), lambda at: _once(
                F.substr(data, (at * 2 + 1).cast("int"), F.lit(64)), lambda w: _once(place(w), lambda length: pointed(at, length))
            ))
        return F.when(
            word.rlike("^[0-9a-f]{64}$"),
            F.when(kind.isin("string", "bytes"), dynamic)
            .when(kind == "address", F.concat(F.lit("0x"), F.right(word, F.lit(40))))
            .when(kind == "bool", F.when(word.rlike("[1-9a-f]"), "true").otherwise("false"))
            .when(kind.startswith("uint") | kind.startswith("int"), _number_text(word, kind.startswith("int")))
            .when(size.isNotNull(), F.concat(F.lit("0x"), F.left(word, size * 2))),
        )

    return _once(word, text)


def _needed(family: str, column, default: int) -> Column:
    count = F.lit(default)
    for event in reg.EVENTS:
        if event.family == family:
            count = F.when(F.col("topic0") == event.topic0, column(event)).otherwise(count)
    return count


def is_well_formed(families=(reg.PAYROLL, reg.ESCROW, reg.ERC20), strict_data: bool = True) -> Column:
    """Enough topics, 32-byte topics, and whole data words for the event at hand."""
    ok = F.lit(False)
    for event in reg.EVENTS:
        if event.family not in families:
            continue
        want_topics = 1 + len(event.indexed)
        want_chars = 2 + 64 * len(event.data)
        shape = F.size("topics") >= want_topics
        if strict_data and event.data:
            shape &= F.length("data") >= want_chars
            shape &= F.substring("data", 1, want_chars).rlike("^0[xX][0-9a-fA-F]*$")
        ok = F.when(F.col("topic0") == event.topic0, shape).otherwise(ok)
    known = F.col("topic0").isin(*[e.topic0 for e in reg.EVENTS if e.family in families])
    hex_topics = F.forall("topics", evm.valid_hash)
    return F.coalesce((F.size("topics") > 0) & hex_topics & F.when(known, ok).otherwise(F.lit(True)), F.lit(False))


def split_valid(logs: DataFrame, families=(reg.PAYROLL, reg.ESCROW, reg.ERC20)) -> tuple[DataFrame, DataFrame]:
    """(decodable logs, quarantined logs); unknown topics are not malformed."""
    flagged = with_topic0(logs).withColumn("_ok", is_well_formed(families))
    return flagged.filter("_ok").drop("_ok"), flagged.filter(~F.col("_ok")).drop("_ok")


def decode_payroll(logs: DataFrame, extra=("block_timestamp",)) -> DataFrame:
    """The seven payroll events as one wide row type; other topics are left out."""
    events = [e for e in reg.EVENTS if e.family == reg.PAYROLL]
    name = F.lit(None).cast("string")
    for e in events:
        name = F.when(F.col("topic0") == e.topic0, e.name).otherwise(name)

    def indexed(field: str) -> Column:
        out = F.lit(None).cast("string")
        for e in events:
            for i, (n, _) in enumerate(e.indexed):
                if n == field:
                    out = F.when(F.col("topic0") == e.topic0, evm.topic_address(_topic(i + 1))).otherwise(out)
        return out

    # one parse per word position, then one choice per column
    words = u256.with_words(
        with_topic0(logs).filter(F.col("topic0").isin(*[e.topic0 for e in events])),
        {f"_w{i}": evm.data_word("data", i) for i in range(3)},
    )

    def data(field: str) -> Column:
        out = F.lit(None).cast(u256.U256)
        for e in events:
            for i, (n, _) in enumerate(e.data):
                if n == field:
                    out = F.when(F.col("topic0") == e.topic0, F.col(f"_w{i}")).otherwise(out)
        return out

    return words.select(
        "chain_id",
        F.col("address").alias("contract_address"),
        name.alias("event_name"),
        indexed("employer").alias("employer"),
        indexed("employee").alias("employee"),
        indexed("previousOwner").alias("previous_owner"),
        indexed("newOwner").alias("new_owner"),
        data("salary").alias("salary"),
        data("allocation").alias("allocation"),
        data("amountPaid").alias("amount_paid"),
        data("fee").alias("fee"),
        data("amountCredited").alias("amount_credited"),
        data("amount").alias("amount"),
        *[c for c in LOG_FIELDS if c != "chain_id"],
        *_extra(logs, extra),
    )


def decode_escrow(logs: DataFrame, extra=("block_timestamp", "created_at"), on_unknown: str = "skip") -> DataFrame:
    """The six escrow events: id, amount where the event has one, raw fields as a map.

    ``escrow_key`` is the id's plain 32-byte word. Look escrows up by it: a
    string predicate reaches the topics, one on the parsed number would not.
    ``on_unknown='unknown'`` keeps other topics as ``Unknown`` (webhook path).
    """
    t = {e.name: e.topic0 for e in reg.EVENTS if e.family == reg.ESCROW}
    topic = F.col("topic0")
    source = with_topic0(logs)
    if on_unknown == "skip":
        source = source.filter(topic.isin(*t.values()))
    source = u256.with_words(
        source, {"_id": evm.topic_word(_topic(1)), "_word": evm.data_word("data", 0)}
    ).withColumns({"_id_text": u256.to_string(F.col("_id")), "_word_text": u256.to_string(F.col("_word"))})

    name = F.lit("Unknown")
    for event, topic0 in t.items():
        name = F.when(topic == topic0, event).otherwise(name)
    priced = topic.isin(t["EscrowCreated"], t["EscrowReleased"], t["EscrowRefunded"], t["DisputeResolved"])

    def only(event: str, value: Column) -> Column:
        return F.when(topic == t[event], value)

    second, third = evm.topic_address(_topic(2)), evm.topic_address(_topic(3))
    # alphabetical, so the JSON rendering has sorted keys
    raw = {
        "amount": F.when(priced, F.col("_word_text")),
        "amountReleased": only("DisputeResolved", F.col("_word_text")),
        "buyer": only("EscrowCreated", second),
        "deliveryTime": only("DeliveryAcknowledged", F.col("_word_text")),
        "disputeFee": only("DisputeRaised", F.col("_word_text")),
        "escrowId": F.col("_id_text"),
        "raisedBy": only("DisputeRaised", second),
        "seller": only("EscrowCreated", third),
        "winner": only("DisputeResolved", second),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in raw.items()])
    return source.select(
        "chain_id",
        F.col("address").alias("contract_address"),
        name.alias("event_type"),
        F.lower(evm.topic_word(_topic(1))).alias("escrow_key"),
        F.col("_id").alias("escrow_id"),
        F.when(priced, F.col("_word")).alias("amount"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("raw"),
        *[c for c in LOG_FIELDS if c != "chain_id"],
        *_extra(logs, extra),
    )


def _pair_event(logs: DataFrame, event: str, token, first: str, second: str, extra) -> DataFrame:
    source = with_topic0(logs).filter((F.col("topic0") == reg.TOPIC[event]) & (F.size("topics") >= 3))
    if token is not None:
        source = source.filter(evm.eq_ci("address", token))
    # judged on the text: a condition on the number would repeat its parsing
    word = evm.data_word("data", 0)
    source = u256.with_words(source.filter(word.isNotNull()), {"amount": word})
    return source.select(
        "chain_id",
        F.col("address").alias("token"),
        evm.topic_address(_topic(1)).alias(first),
        evm.topic_address(_topic(2)).alias(second),
        "amount",
        *[c for c in LOG_FIELDS if c != "chain_id"],
        *_extra(logs, extra),
    )


def decode_transfers(logs: DataFrame, token: str | None = None, extra=("block_timestamp", "arrival")) -> DataFrame:
    """Transfer logs with both indexed addresses and a whole amount word."""
    return _pair_event(logs, "Transfer", token, "from_address", "to_address", extra)


def decode_approvals(logs: DataFrame, token: str | None = None, extra=("block_timestamp",)) -> DataFrame:
    return _pair_event(logs, "Approval", token, "owner", "spender", extra)


def filter_contract(logs: DataFrame, expected: str | None) -> DataFrame:
    """Keep logs of one contract.

    The address falls back to ``account_address``; a log without any address
    passes, and an empty or zero ``expected`` filters nothing.
    """
    logs = logs.withColumn(
        "address", F.coalesce(F.nullif("address", F.lit("")), F.nullif("account_address", F.lit("")))
    )
    if evm.is_zero_address(expected):
        return logs
    return logs.filter(F.col("address").isNull() | (F.lower("address") == expected.strip().lower()))


def deliveries_to_escrow_events(
    logs: DataFrame, expected: str | None = None, chain_id: int = 11155111
) -> DataFrame:
    """Webhook logs to escrow rows: delivery time as block time, unknown topics kept."""
    own = filter_contract(logs, expected)
    shaped = own.select(
        F.lit(chain_id).cast("long").alias("chain_id"),
        F.coalesce(F.lower("address"), F.lit((expected or "").strip().lower())).alias("address"),
        F.lower(F.get("topics", F.lit(0))).alias("topic0"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
        F.coalesce("data", F.lit("")).alias("data"),
        evm.parse_block_number("block_number", "block_number_fallback").alias("block_number"),
        F.lower("tx_hash").alias("tx_hash"),
        "log_index",
        F.coalesce("removed", F.lit(False)).alias("removed"),
        F.coalesce("created_at", F.current_timestamp()).alias("block_timestamp"),
    )
    return decode_escrow(shaped, on_unknown="unknown")


def with_block_time(logs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Attach the block's timestamp; one row per block, joined by number.

    A log without its header fails the job when the time is read, so that no cursor
    passes it; :func:`without` tells which logs have none.

    Spark broadcasts the headers when their measured size allows it and
    otherwise shuffles both sides.
    """
    times = blocks.select(
        "chain_id", "block_number", F.timestamp_seconds("timestamp").alias("block_timestamp")
    )
    joined = logs.drop("block_timestamp").join(times.withColumn("_known", F.lit(True)), ["chain_id", "block_number"], "left")
    return _complete(joined, ["block_timestamp"], F.concat(F.lit("no header of block "), "block_number"))


def with_tx(df: DataFrame, transactions: DataFrame) -> DataFrame:
    """Attach transaction metadata by hash; rows without it fail the job, as in :func:`with_block_time`."""
    meta = transactions.select(
        "chain_id", "tx_hash", "sender", "recipient", "gas_used", "status",
        F.col("block_number").alias("tx_block_number"),
    )
    columns = [c for c in meta.columns if c not in ("chain_id", "tx_hash")]
    joined = df.join(meta.withColumn("_known", F.lit(True)), ["chain_id", "tx_hash"], "left")
    return _complete(joined, columns, F.concat(F.lit("no transaction "), "tx_hash"))


def without(logs: DataFrame, metadata: DataFrame, keys: tuple[str, ...] = ("chain_id", "block_number")) -> DataFrame:
    """Logs whose header (or transaction, by its keys) is not there yet, to be held back."""
    return logs.join(metadata.select(*keys), list(keys), "left_anti")


def _complete(joined: DataFrame, columns: list[str], message: Column) -> DataFrame:
    kinds = {f.name: f.dataType for f in joined.schema}
    checked = {
        c: F.when(F.col("_known"), F.col(c)).otherwise(F.raise_error(message).cast(kinds[c])) for c in columns
    }
    return joined.withColumns(checked).drop("_known")


def ledger_rows(decoded: DataFrame, raw: Column, name: str = "event_name") -> DataFrame:
    """Any decoded event as a ``chain_events`` row with its JSON payload."""
    return decoded.withColumn("raw_data", raw).select(
        "chain_id",
        F.coalesce(*[F.col(c) for c in ("contract_address", "token") if c in decoded.columns]).alias(
            "contract_address"
        ),
        F.col(name).alias("event_name"),
        "tx_hash", "block_number", "log_index", "removed", "raw_data",
        *_extra(decoded, ("block_timestamp", "arrival", "created_at")),
    )


def transfer_json() -> Column:
    return evm.json_object(
        **{"from": F.col("from_address"), "to": F.col("to_address"), "amount": u256.to_string(F.col("amount"))}
    )


def approval_json() -> Column:
    return evm.json_object(
        owner=F.col("owner"), spender=F.col("spender"), value=u256.to_string(F.col("amount"))
    )


def escrow_json() -> Column:
    """The ``raw`` map of :func:`decode_escrow`, whose entries are already sorted."""
    return F.to_json("raw")


def payroll_json() -> Column:
    """Payload of a payroll event: sorted members, exact numbers, absent members left out."""

    def text(name: str, column: str) -> Column:
        return F.concat(F.lit(f'"{name}":"'), F.col(column), F.lit('"'))

    def number(name: str, column: str) -> Column:
        return F.concat(F.lit(f'"{name}":'), u256.to_string(F.col(column)))

    members = [
        number("Allocation", "allocation"), number("Amount", "amount"),
        number("AmountCredited", "amount_credited"), number("AmountPaid", "amount_paid"),
        text("Employee", "employee"), text("Employer", "employer"), number("Fee", "fee"),
        text("NewOwner", "new_owner"), text("PreviousOwner", "previous_owner"),
        number("Salary", "salary"),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
