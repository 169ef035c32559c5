"""Outbound payment-link requests as columns. Sending them is not part of this library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwatch import constants as K
from tillwatch.sources.failures import rupees


def reference_id(payment_id: Column, prefix: str = K.REFERENCE_PREFIX) -> Column:
    """Idempotency key of fixed length: prefix plus leading hex digits of SHA-256."""
    digits = K.REFERENCE_ID_LENGTH - len(prefix)
    return F.concat(F.lit(prefix), F.substring(F.sha2(payment_id, 256), 1, digits))


def masked_contact(customer_id: Column) -> Column:
    """Name, phone and e-mail that belong to nobody: digits come from a hash, the mail domain
    is reserved."""
    digest = F.split(F.substring(F.sha2(customer_id, 256), 1, 9), "")
    digits = F.transform(digest, lambda c: F.pmod(F.conv(c, 16, 10).cast("int"), F.lit(10)).cast("string"))
    return F.struct(
        F.concat(F.lit("Customer "), customer_id).alias("name"),
        F.concat(F.lit("+919"), F.array_join(digits, "")).alias("contact"),
        F.concat(F.lit("customer."), customer_id, F.lit("@example.com")).alias("email"),
    )


def effective_restriction(disallowed_method: Column) -> Column:
    """The disallowed method, where a link can hide it at all."""
    return F.when(disallowed_method.isin(K.RESTRICTABLE_METHODS), disallowed_method)


def restriction_note(disallowed_method: Column) -> Column:
    unsupported = disallowed_method.isNotNull() & ~disallowed_method.isin(K.RESTRICTABLE_METHODS)
    return F.when(
        unsupported, F.concat(F.lit("links cannot hide method "), disallowed_method, F.lit("; sent unrestricted"))
    )


def wire_request(prefix: str = K.REFERENCE_PREFIX) -> Column:
    """Request JSON over the columns of a decision; ``options`` only when a method is hidden."""
    contact = masked_contact(F.col("customer_id"))
    hidden = effective_restriction(F.col("disallowed_method"))
    allow = F.struct(*[(hidden != method).alias(method) for method in K.RESTRICTABLE_METHODS])
    options = F.when(hidden.isNotNull(), F.struct(F.struct(allow.alias("method")).alias("checkout")))
    body = F.struct(
        F.col("amount"), F.lit(K.CURRENCY).alias("currency"),
        F.concat(F.lit("Complete your payment of INR "), rupees(F.col("amount")), F.lit(" for order "),
                 F.col("order_id"), F.lit(".")).alias("description"),
        reference_id(F.col("payment_id"), prefix).alias("reference_id"), contact.alias("customer"),
        F.struct(F.lit(True).alias("sms"), F.lit(True).alias("email")).alias("notify"), options.alias("options"),
    )
    return F.to_json(body)
