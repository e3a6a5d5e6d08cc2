"""Fixed values of the shop: page paths, channels, products and the labels
the reports print. Results only match the original analysis with exactly
these strings, so they are stated here once, plainly.
"""

# --- fixed values: page paths -------------------------------------------
HOME = "/home"
LANDER_1 = "/lander-1"
PRODUCTS = "/products"
MR_FUZZY = "/the-original-mr-fuzzy"
LOVE_BEAR = "/the-forever-love-bear"
CART = "/cart"
SHIPPING = "/shipping"
BILLING = "/billing"
BILLING_2 = "/billing-2"
THANK_YOU = "/thank-you-for-your-order"

# --- fixed values: traffic channels --------------------------------------
GSEARCH = "gsearch"
BSEARCH = "bsearch"
SOCIALBOOK = "socialbook"
NONBRAND = "nonbrand"
BRAND = "brand"
DESKTOP = "desktop"
MOBILE = "mobile"

# referer values the channel-group report tests for organic search, as the
# original analysis typed them (with a comma, so real URLs never match)
ORGANIC_REFERERS_AS_WRITTEN = ("https://www.gsearch,com", "https://www.bsearch,com")
# the same two referers as real URLs
ORGANIC_REFERERS = ("https://www.gsearch.com", "https://www.bsearch.com")

# --- fixed values: printed labels ----------------------------------------
PRE_PRODUCT_2 = "A. Pre_product_2"
POST_PRODUCT_2 = "B. Post_product_2"
PRE_CROSS_SALES_2 = "A. Pre_cross_sales_2"
POST_CROSS_SALES_2 = "B. Post_cross_sales_2"
PERIOD_FALLBACK = "ceck loic"
SEGMENT_HOME = "saw_homepage"
SEGMENT_LANDER = "saw_custom_lander"
SEGMENT_FALLBACK = "check logic"
CHANNEL_ORGANIC = "organic_search"
CHANNEL_PAID_NONBRAND = "paid_nonbrand"
CHANNEL_PAID_BRAND = "paid_brand"
CHANNEL_DIRECT = "direct_type_in"
CHANNEL_SOCIAL = "social_paid"

# --- fixed values: funnel steps (page path, flag column) -----------------
FUNNEL_6 = (
    (PRODUCTS, "product_made_it"),
    (MR_FUZZY, "fuzzy_made_it"),
    (CART, "cart_made_it"),
    (SHIPPING, "shipping_made_it"),
    (BILLING, "billing_made_it"),
    (THANK_YOU, "thank_made_it"),
)
FUNNEL_8 = (
    (HOME, "saw_homepage"),
    (LANDER_1, "saw_custom_lander"),
    (PRODUCTS, "product_made_it"),
    (MR_FUZZY, "mrfuzzy_made_it"),
    (CART, "cart_made_it"),
    (SHIPPING, "shipping_made_it"),
    (BILLING, "billing_made_it"),
    (THANK_YOU, "thankyou_made_it"),
)
# page-level 0/1 columns of the funnel drill-down
PAGE_FLAGS_6 = (
    (PRODUCTS, "products_page"),
    (MR_FUZZY, "mrfuzzy_page"),
    (CART, "cart_page"),
    (SHIPPING, "shipping_page"),
    (BILLING, "billing_page"),
    (THANK_YOU, "thankyou_page"),
)
# funnel count columns, in step order
FUNNEL_COUNT_NAMES = ("to_products", "to_fuzzy", "to_cart", "to_ship", "to_billings", "to_thanks")
SEGMENT_RATE_NAMES = (
    "to_products_click_rate",
    "to_fuzzy_click_rate",
    "to_cart_click_rate",
    "to_ship_click_rates",
    "to_billings_click_rates",
    "to_thanks_click_rates",
)
# weekday columns of the staffing grid, Monday first
WEEKDAY_NAMES = ("mon", "tues", "wed", "turs", "fri", "sat", "sun")
# product revenue / margin columns, product 1..4
PRODUCT_MARGIN_NAMES = (
    ("mrfuzz_rev", "mrfuzz_mr"),
    ("lovebear_rev", "lovebear_mr"),
    ("bdbear_rev", "bdbear_mr"),
    ("minbear_rev", "minbear_mr"),
)

# --- fixed values: date bounds of the original questions, statement order --
# (date-only text means midnight; "between" includes both ends)
TRAFFIC_UNTIL = "2012-04-12"  # S02 sources, S03 gsearch conversion
WEEKLY_VOLUME_UNTIL = "2012-05-12"  # S04
DEVICE_CVR_UNTIL = "2012-05-11"  # S05
WEEKLY_DEVICE_FROM, WEEKLY_DEVICE_TO = "2012-04-15", "2012-06-09"  # S06
TOP_PAGES_UNTIL = "2012-06-09"  # S07
LANDING_UNTIL = "2012-06-14"  # S09 .. S15
LANDER_TEST_UNTIL = "2012-07-28"  # S17 .. S22, S46 .. S50
LANDING_TREND_AFTER, LANDING_TREND_BEFORE = "2012-06-01", "2012-08-31"  # S23 .. S27
FUNNEL_FROM, FUNNEL_TO = "2012-08-05", "2012-09-05"  # S28 .. S31
BILLING_TEST_UNTIL = "2012-11-10"  # S38, S40
MID_PROJECT_UNTIL = "2012-11-27"  # S41 .. S45, S51, S52
LANDER_FUNNEL_AFTER, LANDER_FUNNEL_BEFORE = "2012-06-19", "2012-07-28"  # S53 .. S55
BILLING_REVENUE_AFTER, BILLING_REVENUE_BEFORE = "2012-09-10", "2012-11-10"  # S56
WEEKLY_SOURCES_FROM, WEEKLY_SOURCES_TO = "2012-8-22", "2012-11-29"  # S57
SOURCE_MOBILE_FROM, SOURCE_MOBILE_TO = "2012-8-22", "2012-11-30"  # S58
DEVICE_SOURCE_FROM, DEVICE_SOURCE_TO = "2012-8-22", "2012-9-19"  # S59
BID_CHANGE_FROM, BID_CHANGE_TO = "2012-11-4", "2012-12-22"  # S60
SEASONALITY_THROUGH = "2012-12-31"  # S61, S62 (<=, so midnight of that day)
STAFFING_FROM, STAFFING_TO = "2012-9-15", "2012-11-15"  # S63
SALES_UNTIL = "2013-01-04"  # S64
LAUNCH_AFTER, LAUNCH_BEFORE = "2012-4-1", "2013-4-5"  # S65
PATH_AFTER, PATH_BEFORE, PRODUCT_2_SPLIT = "2012-10-6", "2013-4-6", "2013-01-06"  # S66 .. S70
CART_FROM, CART_TO, CART_SPLIT, CART_AFTER_FROM = "2013-8-25", "2013-10-25", "2013-09-05", "2013-01-06"  # S71 .. S76
SCORECARD_FROM, SCORECARD_TO, SCORECARD_SPLIT = "2013-11-12", "2014-01-12", "2013-12-12"  # S77
REFUND_UNTIL = "2014-10-15"  # S78
REPEAT_FROM, REPEAT_BEFORE = "2014-1-1", "2014-11-01"  # S79 .. S84 (from included, before excluded)
CHANNEL_GROUP_FROM, CHANNEL_GROUP_TO = "2014-01-01", "2014-11-05"  # S85
NEW_VS_REPEAT_FROM, NEW_VS_REPEAT_TO = "2014-01-01", "2014-11-08"  # S86
RECENT_ORDERS_AFTER = "2012-12-05"  # S93, S94
