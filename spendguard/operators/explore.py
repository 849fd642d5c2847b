"""Filters, display columns and text for people who read the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.functions.text import format_brl

# Display texts.
FEATURE_LABELS = {
    "valor_adjusted": "Valor corrigido pela inflação (R$ Jan/2026)",
    "mean_value": "Gasto médio histórico do parlamentar nesta verba",
    "year": "Ano da despesa",
    "month": "Mês da despesa (1–12)",
    "quarter": "Trimestre (1–4)",
    "day_of_week": "Dia da semana (0=seg, 6=dom)",
    "is_reversal": "É uma devolução/estorno",
}
PROMPT_LABELS = {
    "valor_adjusted": "valor da despesa muito acima do histórico da categoria",
    "mean_value": "desvio em relação à média histórica deste parlamentar nesta verba",
    "year": "ano atípico da despesa",
    "month": "mês atípico da despesa",
    "quarter": "trimestre atípico da despesa",
    "day_of_week": "dia da semana incomum para esta despesa",
}
WEEKDAYS = ("Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado", "Domingo")
PROMPT_OPENING = (
    "Você é um auditor público. Explique em 2 a 3 frases simples e diretas por que esta despesa "
    "parlamentar é estatisticamente anômala, sem usar jargão técnico. Seja objetivo e factual."
)
PROMPT_CLOSING = (
    "Responda apenas com a explicação em português, sem introdução, saudação ou conclusão. "
    "Não use markdown. Não repita os dados acima — apenas explique a anomalia."
)


def explore(
    df: DataFrame,
    years: Sequence[int] = (),
    categories: Sequence[str] = (),
    entities: Sequence[str] = (),
    splits: Sequence[str] = (),
    flagged_only: bool = False,
    limit: int | None = None,
    order: Sequence[Column] = (),
) -> DataFrame:
    """Rows that satisfy all given filters; an empty filter accepts everything."""
    chosen = ((C.YEAR, years), (C.VERBA, categories), (C.CONTA, entities), (C.SPLIT, splits))
    for column, values in chosen:
        if values:
            df = df.where(F.col(column).isin(*values))
    if flagged_only:
        df = df.where(F.col("ensemble_flag") == 1)
    if order:
        df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def filter_kpis(df: DataFrame, amount: str = C.VALOR_ADJUSTED) -> DataFrame:
    """Rows, total amount, flagged rows and flag rate of a filtered table."""
    return df.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(amount).alias("total_valor"),
        F.coalesce(F.sum("ensemble_flag"), F.lit(0)).cast("bigint").alias("n_flagged"),
        F.coalesce(100 * F.avg("ensemble_flag"), F.lit(0.0)).alias("flag_rate_pct"),
    )


def annotate_records(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """All records with flag and score; records that were not scored get 0."""
    found = predictions.select(C.RECORD_ID, "ensemble_flag", "ensemble_score")
    return records.join(found, C.RECORD_ID, "left").withColumns(
        {
            "ensemble_flag": F.coalesce("ensemble_flag", F.lit(0)),
            "ensemble_score": F.coalesce("ensemble_score", F.lit(0.0)),
        }
    )


def normal_records(records: DataFrame, flagged: DataFrame, years: Sequence[int]) -> DataFrame:
    """Records of the given years that are not flagged."""
    return records.where(F.col(C.YEAR).isin(*years)).join(flagged.select(C.RECORD_ID), C.RECORD_ID, "left_anti")


def _labels(name: Column, labels: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, name), name)


def payee_or_spender() -> Column:
    return F.coalesce(F.when(F.col(C.FAVORECIDO) != "nan", F.col(C.FAVORECIDO)), F.col(C.CONTA), F.lit("?"))


def decode_feature(name: Column, style: str = "report") -> Column:
    """Readable form of a feature name; hashed features name the record's own spender or payee."""
    spender = F.coalesce(F.col(C.CONTA), F.lit("?"))
    if style == "report":
        as_spender = F.concat(F.lit("Parlamentar (hash): **"), spender, F.lit("**"))
        as_payee = F.concat(F.lit("Favorecido (hash): **"), payee_or_spender(), F.lit("**"))
        labels = FEATURE_LABELS
    else:
        as_spender = F.concat(F.lit("identidade do parlamentar ("), spender, F.lit(")"))
        as_payee = F.concat(F.lit("beneficiário incomum ("), payee_or_spender(), F.lit(")"))
        labels = PROMPT_LABELS
    return (
        F.when(name.startswith("cta_"), as_spender).when(name.startswith("fav_"), as_payee).otherwise(_labels(name, labels))
    )


def prompt_table(flagged: DataFrame) -> DataFrame:
    """Text that asks for an explanation of each flagged record; nothing is sent anywhere."""
    due = F.format_string("%02d/%d", F.coalesce(F.col("month"), F.lit(0)), F.col(C.YEAR))
    strength = F.format_string("%.2f", F.abs(F.coalesce(F.col("top_shap_value"), F.lit(0.0))))
    facts = F.concat_ws(
        "\n",
        F.lit("Dados da despesa:"),
        F.concat(F.lit("- Parlamentar: "), F.coalesce(F.col(C.CONTA), F.lit("?"))),
        F.concat(F.lit("- Categoria de verba: "), F.col(C.CATEGORY_KEY)),
        F.concat(F.lit("- Valor gasto: "), format_brl(F.col(C.VALOR_ADJUSTED), "—")),
        F.concat(F.lit("- Mês/Ano: "), due),
        F.concat(F.lit("- Média histórica deste parlamentar nesta verba: "), format_brl(F.col("mean_value"), "—")),
        F.concat(
            F.lit("- Principal fator de anomalia: "),
            decode_feature(F.coalesce(F.col("top_feature"), F.lit("")), "prompt"),
            F.lit(" (intensidade: "),
            strength,
            F.lit(")"),
        ),
    )
    prompt = F.concat_ws("\n\n", F.lit(PROMPT_OPENING), facts, F.lit(PROMPT_CLOSING))
    return flagged.select(C.CATEGORY_KEY, C.RECORD_ID, prompt.alias("prompt"))


def display_columns(df: DataFrame, amount: str = C.VALOR_ADJUSTED) -> DataFrame:
    """Money text, month/year text, weekday name, flag text and rounded score."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return df.withColumns(
        {
            "valor_fmt": format_brl(F.col(amount)),
            "mes_ano": F.concat(F.lpad(F.col("month").cast("string"), 2, "0"), F.lit("/"), F.col(C.YEAR).cast("string")),
            "dia_semana": F.get(names, F.col("day_of_week")),
            "anomalia": F.when(F.col("ensemble_flag") == 1, F.lit("⚠️ Anômalo")).otherwise(F.lit("—")),
            "score": F.round("ensemble_score", 4),
            "favorecido": payee_or_spender(),
        }
    )
