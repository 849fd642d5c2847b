"""Canonical column names of an expense table."""

RECORD_ID = "record_id"        # BIGINT, unique per record
VERBA = "verba"                # spending category, the unit of modelling
CATEGORY_KEY = "category_key"  # file-safe form of the category
DESCRICAO = "descricao"
CONTA = "conta"                # spender
FAVORECIDO = "favorecido"      # payee
TRECHO = "trecho"
VENCIMENTO = "vencimento"      # due date
VALOR = "valor"                # nominal amount
VALOR_ADJUSTED = "valor_adjusted"
YEAR = "year"
IS_REVERSAL = "is_reversal"
SPLIT = "split"

# Numeric model features, in the order used for every model table.
NUMERIC_FEATURES = ("year", "valor_adjusted", "month", "quarter", "day_of_week", "mean_value")
# Hashed features: bucket column, short name used for feature labels.
BUCKET_FEATURES = (("fav_bucket", "fav"), ("cta_bucket", "cta"))
