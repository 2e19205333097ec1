"""The nine canonical tables: how to find their files and type their columns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableSpec:
    name: str
    required: bool
    file_has: tuple[str, ...]
    file_lacks: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()  # must be present
    dates: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)  # canonical -> accepted headers
    key: tuple[str, ...] = ()


# Table names, file-name tokens, column names and accepted headers
# of the marketplace extract. Files are assigned in this order.
TABLES: tuple[TableSpec, ...] = (
    TableSpec(
        "customers",
        required=True,
        file_has=("customer",),
        columns=("customer_id", "customer_unique_id", "customer_city", "customer_state"),
        numbers=("customer_zip_code_prefix",),
        aliases={
            "customer_id": ("id_cliente",),
            "customer_unique_id": ("id_cliente_unico",),
            "customer_city": ("cidade_cliente",),
            "customer_state": ("estado_cliente",),
            "customer_zip_code_prefix": ("customer_zip_code", "cep_cliente"),
        },
        key=("customer_id",),
    ),
    TableSpec(
        "orders",
        required=True,
        file_has=("order",),
        file_lacks=("item", "payment", "review"),
        columns=(
            "order_id",
            "customer_id",
            "order_status",
            "order_purchase_timestamp",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
        ),
        dates=(
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
        ),
        aliases={
            "order_id": ("pedido_id",),
            "customer_id": ("id_cliente",),
            "order_status": ("status_pedido",),
            "order_purchase_timestamp": ("purchase_timestamp", "order_purchase_date", "data_compra_pedido"),
            "order_approved_at": ("data_aprovacao_pedido",),
            "order_delivered_carrier_date": ("data_envio_transportadora",),
            "order_delivered_customer_date": ("data_entrega_cliente",),
            "order_estimated_delivery_date": ("data_estimada_entrega",),
        },
        key=("order_id",),
    ),
    TableSpec(
        "order_items",
        required=True,
        file_has=("order", "item"),
        file_lacks=("payment", "review"),
        columns=("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"),
        dates=("shipping_limit_date",),
        numbers=("order_item_id", "price", "freight_value"),
        aliases={
            "order_id": ("pedido_id",),
            "order_item_id": ("item_pedido_id",),
            "product_id": ("produto_id",),
            "seller_id": ("vendedor_id",),
            "shipping_limit_date": ("data_limite_envio",),
            "price": ("preco",),
            "freight_value": ("valor_frete",),
        },
        key=("order_id", "order_item_id"),
    ),
    TableSpec(
        "order_payments",
        required=False,
        file_has=("order", "payment"),
        columns=("order_id", "payment_value"),
        numbers=("payment_sequential", "payment_installments", "payment_value"),
        aliases={
            "order_id": ("pedido_id",),
            "payment_sequential": ("pagamento_sequencial",),
            "payment_type": ("tipo_pagamento",),
            "payment_installments": ("parcelas_pagamento",),
            "payment_value": ("valor_pagamento",),
        },
        key=("order_id", "payment_sequential"),
    ),
    TableSpec(
        "order_reviews",
        required=True,
        file_has=("order", "review"),
        columns=("order_id", "review_score"),
        dates=("review_creation_date", "review_answer_timestamp"),
        numbers=("review_score",),
        aliases={
            "review_id": ("avaliacao_id",),
            "order_id": ("pedido_id",),
            "review_score": ("nota_avaliacao",),
            "review_creation_date": ("data_criacao_avaliacao",),
            "review_answer_timestamp": ("data_resposta_avaliacao",),
        },
    ),
    TableSpec(
        "products",
        required=True,
        file_has=("product",),
        file_lacks=("translation",),
        columns=("product_id", "product_category_name"),
        numbers=(
            "product_name_lenght",
            "product_description_lenght",
            "product_photos_qty",
            "product_weight_g",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
        ),
        aliases={
            "product_id": ("produto_id",),
            "product_category_name": ("categoria_produto",),
        },
        key=("product_id",),
    ),
    TableSpec(
        "sellers",
        required=True,
        file_has=("seller",),
        columns=("seller_id", "seller_city", "seller_state"),
        numbers=("seller_zip_code_prefix",),
        aliases={
            "seller_id": ("vendedor_id",),
            "seller_city": ("cidade_vendedor",),
            "seller_state": ("estado_vendedor",),
            "seller_zip_code_prefix": ("cep_vendedor",),
        },
        key=("seller_id",),
    ),
    TableSpec(
        "geolocation",
        required=False,
        file_has=("geolocation",),
        columns=("geolocation_zip_code_prefix", "geolocation_city", "geolocation_state"),
        numbers=("geolocation_lat", "geolocation_lng"),
        aliases={
            "geolocation_zip_code_prefix": ("cep_geolocalizacao",),
            "geolocation_city": ("cidade_geolocalizacao",),
            "geolocation_state": ("estado_geolocalizacao",),
            "geolocation_lat": ("latitude",),
            "geolocation_lng": ("longitude",),
        },
    ),
    TableSpec(
        "translation",
        required=False,
        file_has=("translation",),
        columns=("product_category_name", "product_category_name_english"),
        aliases={
            "product_category_name": ("categoria_produto",),
            "product_category_name_english": ("categoria_produto_english", "categoria_produto_ingles"),
        },
        key=("product_category_name",),
    ),
)

SPECS = {spec.name: spec for spec in TABLES}
