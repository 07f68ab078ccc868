"""Fixed values that must equal the shop's own rules.

Kept together, as plain text, in their natural order.
"""

# Order statuses accepted by a status change, and the subset a customer may still cancel.
ORDER_STATUSES = ("created", "approved", "shipped", "delivered", "cancelled")
CANCELLABLE_STATUSES = ("created", "approved")
CANCELLED = "cancelled"
# Status change -> timestamp column stamped by it.
STATUS_STAMP_COLUMNS = {
    "approved": "order_approved_at",
    "shipped": "order_delivered_carrier_date",
    "delivered": "order_delivered_customer_date",
}

# Customer segments: no live order -> "nouveau"; otherwise by spend, upper bounds exclusive.
SEGMENT_NEW = "nouveau"
SEGMENTS = ("casual", "regular", "premium", "vip")
SEGMENT_THRESHOLDS = (200.0, 1000.0, 2000.0)

# Id formats: prefix and zero-padded width of the numeric part.
ID_FORMATS = {
    "product_id": ("PROD_", 5),
    "stock_id": ("STOCK_", 5),
    "customer_id": ("CUST_", 6),
    "order_id": ("ORDER_", 6),
    "review_id": ("REVIEW_", 6),
    "seller_id": ("SELLER_", 4),
}

# Input formats (French phone numbers and postal codes).
PHONE_PATTERN = r"^0[1-9][0-9]{8}\z"
PHONE_SEPARATORS = r"[\s.\-]"
ZIP_PATTERN = r"^[0-9]{5}\z"
EMAIL_MAX_LENGTH = 254
MIN_RELEASE_YEAR = 1970
RELEASE_YEAR_SLACK = 2
REVIEW_SCORE_MIN, REVIEW_SCORE_MAX = 1, 5

# Placing an order from a cart.
ORDER_LINE_FREIGHT = "4.99"
NEW_ORDER_STATUS = "created"
SHIPPING_LIMIT_TIME = "23:59:59"

# Stock row created with each new product.
NEW_PRODUCT_STOCK = {
    "seller_id": "SELLER_0001",
    "quantity_in_stock": 10,
    "quantity_reserved": 0,
    "quantity_available": 10,
    "min_stock_level": 3,
    "reorder_point": 5,
    "warehouse_location": "A-00-00",
    "stock_condition": "new",
}
PRODUCT_IMAGE_PREFIX = "../static/images/"
PRODUCT_IMAGE_SUFFIX = ".png"

# Column defaults of the tables (used when an insert leaves them out).
DEFAULT_ORDER_STATUS = "pending"
DEFAULT_QUANTITY = 1
DEFAULT_FREIGHT = "0"
DEFAULT_INSTALLMENTS = 1
DEFAULT_SELLER_TYPE = "Standard"
DEFAULT_MIN_STOCK_LEVEL = 12
DEFAULT_REORDER_POINT = 19
DEFAULT_STOCK_CONDITION = "new"

# Display helpers.
PREVIEW_CHARS = 120
ELLIPSIS = "…"
IN_STOCK_LABEL, OUT_OF_STOCK_LABEL = "En stock", "Rupture de stock"
YES_LABEL, NO_LABEL = "Oui", "Non"

# Result caps that are features of the shop (autocomplete lists, home page reviews).
AUTOCOMPLETE_LIMIT = 50
RECENT_REVIEWS_LIMIT = 6
