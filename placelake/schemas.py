"""The library of CSS schemas, in order of precedence, and the schema of records that a language model returns."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Schema:
    """Selectors of a kind of page: ``globs`` say for which URLs, ``base`` finds items, ``fields`` their parts."""

    name: str
    globs: tuple[str, ...]
    base: str
    fields: dict[str, str]
    links: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()

    def css(self) -> dict:
        """The declarative form that ``extract.css_extract`` takes: fields in ``links`` are hrefs, those in ``lists`` have many values."""
        fields = []
        for name, selector in self.fields.items():
            kind = {"type": "attribute", "attribute": "href"} if name in self.links else {"type": "text"}
            fields.append({"name": name, "selector": selector, "multiple": name in self.lists, **kind})
        return {"name": self.name, "baseSelector": self.base, "fields": fields}


# Schemas with their globs and selectors.
SCHEMAS = (
    Schema(
        "standard_facility_listing", ("*facility*", "*location*", "*community*", "*center*"),
        ".facility-card, .location-card, .community-card, .center-card",
        {
            "facility_name": "h1, h2, h3, .facility-name, .location-name, .community-name",
            "address": ".address, .location, .street-address, [itemprop='streetAddress']",
            "city": ".city, [itemprop='addressLocality']",
            "state": ".state, [itemprop='addressRegion']",
            "zip_code": ".zip, .postal-code, [itemprop='postalCode']",
            "phone": ".phone, .telephone, [itemprop='telephone'], a[href^='tel:']",
            "website": "a[href*='http'], .website-link, .facility-link",
            "facility_type": ".facility-type, .care-type, .service-type",
            "services": ".services li, .amenities li, .care-services li",
        },
        ("website",), ("services",),
    ),
    Schema(
        "table_facility_listing", ("*table*", "*directory*", "*list*"),
        "table tr, .facility-table tr, .location-table tr",
        {
            "facility_name": "td:first-child, .facility-name, .name-column",
            "address": "td:nth-child(2), .address-column",
            "phone": "td:nth-child(3), .phone-column, a[href^='tel:']",
            "facility_type": "td:nth-child(4), .type-column",
        },
    ),
    Schema(
        "individual_facility_detail", ("*facility/*", "*location/*", "*community/*"),
        "body, .facility-details, .location-details",
        {
            "facility_name": "h1, .facility-name, .page-title",
            "address": ".address, .contact-info .address, [itemprop='streetAddress']",
            "city": ".city, [itemprop='addressLocality']",
            "state": ".state, [itemprop='addressRegion']",
            "zip_code": ".zip, [itemprop='postalCode']",
            "phone": ".phone, [itemprop='telephone'], a[href^='tel:']",
            "email": ".email, a[href^='mailto:']",
            "administrator": ".administrator, .director, .manager",
            "beds": ".beds, .capacity, .bed-count",
            "services": ".services li, .amenities li, .features li",
            "description": ".description, .about, .overview",
        },
        (), ("services",),
    ),
    Schema(
        "sunrise_senior_living", ("*sunriseseniorliving.com*",),
        ".community-card, .location-result",
        {
            "facility_name": ".community-name, h3",
            "address": ".address-line-1",
            "city_state_zip": ".address-line-2",
            "phone": ".phone-number, a[href^='tel:']",
            "care_types": ".care-types li, .services li",
        },
        (), ("care_types",),
    ),
    Schema(
        "lcca_state_listing", ("*lcca.com/locations/*",),
        ".facCard",
        {
            "facility_name": ".facName h2",
            "address": ".facAddress",
            "city": "span[itemprop='addressLocality']",
            "state": "span[itemprop='addressRegion']",
            "zip_code": "span[itemprop='postalCode']",
            "phone": "a[href^='tel:']",
            "website": "a.btnMainCTA",
            "facility_type": ".serviceType li:first-child",
            "services": ".serviceType li",
        },
        ("phone", "website"), ("services",),
    ),
)

# Fields of a record.
TEXT_FIELDS = (
    "name", "facility_type", "address", "city", "state", "zip_code", "phone", "email", "website", "administrator", "beds",
    "description", "license_number", "medicare_provider_id", "accreditation", "visiting_hours",
)
LIST_FIELDS = ("services_offered", "specialties", "amenities")
MODEL_REPLY = f"facilities array<struct<{', '.join([f'{c}: string' for c in TEXT_FIELDS] + [f'{c}: array<string>' for c in LIST_FIELDS])}>>"
