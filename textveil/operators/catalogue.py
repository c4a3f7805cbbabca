"""The catalogue of placeholder types: fixed defaults, overlays, checks and views of it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finders, normalize, validate

SWEEPS = ("word", "icase", "exact", "off")


@dataclass(frozen=True)
class Kind:
    """A placeholder type."""

    name: str
    labels: tuple[str, ...]
    normalizer: str = "casefold"
    validator: str | None = None
    backstop: str | None = None
    sweep: str = "word"
    threshold: float | None = None
    reversible: bool = True
    on: bool = True


#: The types that come with the library.
DEFAULTS = [
    Kind("PERSON", ("person", "full_name", "first_name", "last_name"), "person"),
    Kind("EMAIL", ("email",), "email", "email_syntax", "email", "icase"),
    Kind("PHONE", ("phone_number",), "phone", "phone_shape", "phone", "exact"),
    Kind("DATE_OF_BIRTH", ("date_of_birth",), "date_iso", sweep="exact", threshold=0.7),
    Kind("ADDRESS", ("address", "street_address"), threshold=0.9),
    Kind("CITY", ("city",), sweep="off", threshold=0.7, on=False),
    Kind("REGION", ("state_or_region",), sweep="off", threshold=0.7, on=False),
    Kind("POSTAL_CODE", ("postal_code",), "digits", "postal_de", sweep="exact", threshold=0.6),
    Kind("COUNTRY", ("country",), sweep="off", threshold=0.8, on=False),
    Kind("NATIONAL_ID", ("government_id", "national_id_number"), "strip_upper", sweep="exact", threshold=0.7),
    Kind("PASSPORT", ("passport_number",), "strip_upper", sweep="exact", threshold=0.6),
    Kind("DRIVERS_LICENSE", ("drivers_license_number",), "strip_upper", sweep="exact", threshold=0.6),
    Kind("LICENSE_NUMBER", ("license_number",), "strip_upper", sweep="exact", threshold=0.7),
    Kind("TAX_ID", ("tax_id", "tax_number"), "strip_upper", "tax_de", "vat_de", "exact"),
    Kind("ACCOUNT_NUMBER", ("bank_account", "account_number"), "strip_upper", sweep="exact", threshold=0.6),
    Kind("ROUTING_NUMBER", ("routing_number",), "strip_upper", "bank_routing_de", sweep="exact", threshold=0.6),
    Kind("IBAN", ("iban",), "strip_upper", "iban_mod97", "iban", "exact", 0.5),
    Kind("CARD", ("payment_card", "card_number"), "digits", "luhn", "card", "exact", 0.5, reversible=False),
    Kind("CARD_EXPIRY", ("card_expiry",), "expiry", "expiry_shape", sweep="exact", threshold=0.6),
    Kind("CARD_CVV", ("card_cvv",), "digits", "cvv_shape", sweep="exact", threshold=0.6, reversible=False),
    Kind("USERNAME", ("username",), threshold=0.8),
    Kind("IP", ("ip_address",), "casefold", "ip_parse", "ip", "exact", 0.5),
    Kind("ACCOUNT_ID", ("account_id",), sweep="exact", threshold=0.8),
    Kind("SECRET", ("password", "api_key", "access_token"), "identity", sweep="exact", threshold=0.8, reversible=False),
    Kind("DATE", ("sensitive_date", "document_date", "expiration_date", "transaction_date"), "date_iso", sweep="exact", threshold=0.8, on=False),
]


@dataclass(frozen=True)
class Catalogue:
    kinds: tuple[Kind, ...] = tuple(DEFAULTS)
    blanket: float = 0.5
    known: dict = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self):
        claimed: dict[str, str] = {}
        for k in self.kinds:
            for what, have in ((k.normalizer, normalize.REGISTRY), (k.validator, validate.REGISTRY), (k.backstop, finders.REGISTRY)):
                if what is not None and what not in have:
                    raise ValueError(f"{k.name}: unknown name {what!r}")
            if k.sweep not in SWEEPS:
                raise ValueError(f"{k.name}: unknown sweep {k.sweep!r}")
            if k.threshold is not None and not 0 <= k.threshold <= 1:
                raise ValueError(f"{k.name}: the threshold is not between 0 and 1")
            for label in k.labels if k.on else ():
                if claimed.setdefault(label, k.name) != k.name:
                    raise ValueError(f"label {label!r} is claimed by {claimed[label]} and {k.name}")

    def enabled(self) -> list[Kind]:
        return [k for k in self.kinds if k.on]

    def overlaid(self, changes: Mapping[str, Mapping]) -> Catalogue:
        """With fields of types changed, or types added; lists are replaced."""
        have = {k.name: k for k in self.kinds}
        for name, change in changes.items():
            fields = {**change, **({"labels": tuple(change["labels"])} if "labels" in change else {})}
            have[name] = replace(have[name], **fields) if name in have else Kind(name, fields.pop("labels", ()), **fields)
        return Catalogue(tuple(have.values()), self.blanket)

    def thresholds(self) -> dict[str, float]:
        return {k.name: k.threshold for k in self.enabled() if k.threshold is not None}

    def validators(self) -> dict[str, str]:
        return {k.name: k.validator for k in self.enabled() if k.validator}

    def sweeps(self) -> dict[str, str]:
        return {k.name: k.sweep for k in self.enabled()}

    def irreversible(self) -> list[str]:
        return [k.name for k in self.kinds if not k.reversible]

    def labels(self) -> dict[str, str]:
        return {label: k.name for k in self.enabled() for label in k.labels}

    def routed(self, spans: DataFrame, label: str = "label") -> DataFrame:
        """``spans`` with the ``type`` of their label, by a join with the enabled types' labels (some dozen rows); null for an unknown one."""
        known = self.frame(spans.sparkSession).where("enabled").select(F.explode("labels").alias("__label"), F.col("name").alias("type"))
        return spans.join(F.broadcast(known), F.col(label) == F.col("__label"), "left").drop("__label")

    def fingerprint(self) -> str:
        """A digest of the enabled types; any change to one of them, or to which are enabled, changes it."""
        return hashlib.sha256(json.dumps([asdict(k) for k in sorted(self.enabled(), key=lambda k: k.name)], sort_keys=True).encode()).hexdigest()

    def frame(self, spark: SparkSession) -> DataFrame:
        """name, labels, normalizer, validator, backstop, sweep, threshold, reversible, enabled of each type."""
        rows = [(k.name, list(k.labels), k.normalizer, k.validator, k.backstop, k.sweep, k.threshold, k.reversible, k.on) for k in self.kinds]
        return spark.createDataFrame(rows, "name string, labels array<string>, normalizer string, validator string, backstop string, sweep string, threshold double, reversible boolean, enabled boolean")
