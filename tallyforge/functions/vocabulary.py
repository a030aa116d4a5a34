"""Closed vocabularies and lookup tables of the economics engine (fixed values)."""

from __future__ import annotations

COMPONENT_TYPES = (
    "item_gross", "item_discount", "item_net", "subtotal", "packing_charge", "handling_fee", "delivery_charge", "platform_fee", "other_charge",
    "cgst", "sgst", "igst", "cess", "tax", "coupon_discount", "membership_benefit", "invoice_total", "customer_total", "payment_assertion", "refund",
    "rounding_adjustment", "unresolved", "unexplained_discount_residual", "unexplained_financial_residual",
)

#: Types that lower what a customer pays.
DISCOUNTS = ("item_discount", "coupon_discount", "membership_benefit")
TOTALS = ("invoice_total", "customer_total")
#: Types that take no part in a document's calculated sum.
NOT_CALCULATED = (*TOTALS, "payment_assertion", "refund", "subtotal", "unresolved")
#: The same for a bundle of documents.
NOT_CALCULATED_IN_BUNDLES = (*NOT_CALCULATED, "unexplained_discount_residual", "unexplained_financial_residual")

MERCHANT_ROLES = ("zomato_merchant_invoice", "swiggy_restaurant_invoice", "swiggy_instamart_seller_invoice")
PLATFORM_ROLES = ("zomato_platform_fee_invoice", "swiggy_platform_fee_invoice")
DELIVERY_ROLES = ("zomato_delivery_service_invoice",)
SUMMARY_ROLES = ("zomato_order_summary", "swiggy_order_history_report")

#: Which document role speaks with how much authority on a component type: (types, ((roles, score), ...), score of other roles).
ROLE_AUTHORITY = (
    (("item_gross", "item_net", "item_discount", "packing_charge", "tax", "cgst", "sgst", "igst", "cess"), ((MERCHANT_ROLES, 100), (SUMMARY_ROLES, 60)), 30),
    (("platform_fee", "handling_fee", "membership_benefit"), ((PLATFORM_ROLES, 100), (SUMMARY_ROLES, 80)), 30),
    (("delivery_charge",), ((DELIVERY_ROLES, 100), (SUMMARY_ROLES, 80)), 40),
    (TOTALS, ((("zomato_order_summary",), 100), (("swiggy_order_history_report",), 95), (MERCHANT_ROLES, 70)), 40),
    (("coupon_discount",), ((SUMMARY_ROLES, 100), (PLATFORM_ROLES, 80)), 40),
)
OTHER_AUTHORITY = 50

#: Authority of a source kind for a family of facts; pairs not listed have none.
SOURCE_AUTHORITY = {
    "customer_payable_total": {"order_summary": "1.00", "restaurant_invoice": "0.45", "platform_fee_invoice": "0.35"},
    "restaurant_taxable_supply": {"restaurant_invoice": "1.00", "order_summary": "0.55"},
    "platform_service_fee": {"platform_fee_invoice": "1.00", "order_summary": "0.65"},
    "grocery_item_tax": {"seller_tax_invoice": "1.00", "order_summary": "0.40"},
    "delivery_person_mention": {"order_summary": "1.00", "delivery_invoice": "0.90"},
    "actual_bank_debit": {"bank_statement": "1.00"},
}
