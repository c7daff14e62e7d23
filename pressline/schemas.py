"""Explicit schemas of the engine's entities; nothing is inferred."""

from __future__ import annotations

ATTEMPT = "struct<provider:string,outcome:string,ms:bigint,symbol:string,error:string>"
RIGHTS = "struct<bodyAllowed:boolean,imageAllowed:boolean,attribution:string,licenseStatus:string,imageAttribution:string>"
HINT = "struct<ticker:string,exchange:string,country:string,name:string,externalId:string>"

COMPANIES = "id bigint, ticker string, company_name string, name_normalized string, sector string, country string, is_us_listed boolean, exchange_hint string, resolution_status string, resolution_note string, resolved_at timestamp, is_active boolean"
LISTINGS = "id bigint, company_id bigint, exchange_code string, mic string, symbol string, symbol_format string, security_kind string, country string, currency string, figi string, share_class_figi string, is_us boolean, is_primary boolean, confidence decimal(3,2), source string, resolved_at timestamp"
ARTICLES = "id bigint, dedupe_hash string, content_hash string, url string, url_canonical string, headline string, summary string, source string, provider string, published_at timestamp, first_seen_at timestamp, image_url string, language string, source_tier int, is_market_wide boolean"
ARTICLE_COMPANIES = "article_id bigint, company_id bigint, match_method string, confidence decimal(3,2), relevance decimal(3,2), relevance_reason string"
FETCH_RUNS = "id bigint, trigger string, status string, started_at timestamp, finished_at timestamp, companies_total int, companies_ok int, companies_no_news int, companies_refused int, companies_failed int, companies_skipped int, articles_seen int, articles_new int, articles_rejected int, notes string"
FETCH_RUN_COMPANIES = f"run_id bigint, company_id bigint, provider string, outcome string, articles_seen int, articles_new int, rejected int, error string, duration_ms bigint, provider_attempts array<{ATTEMPT}>"
FETCH_STATE = "company_id bigint, provider string, last_success_at timestamp, last_article_at timestamp, consecutive_failures int, suppressed_until timestamp"
V2_ARTICLES = f"id string, provider_id string, provider_article_id string, headline string, summary string, body string, publisher string, publisher_url string, url string, image_url string, published_at timestamp, updated_at timestamp, received_at timestamp, language string, topics array<string>, genre string, rights {RIGHTS}, content_hash string, revision int, correction boolean, deleted boolean, entity_evidence array<{HINT}>"
V2_ARTICLE_COMPANIES = "article_id string, company_id bigint, evidence string"
V2_REVISIONS = "article_id string, revision int, action string, snapshot string"
V2_PROVIDERS = "provider_id string, enabled boolean, configured boolean, display_licensed boolean, full_text_enabled boolean, free boolean, supports_full_text boolean, requests_today int, budget int, budget_day date, last_error string, last_success_at timestamp, refresh_minutes int"
V2_ALIASES = "company_id bigint, alias_name string, issuer_name string, ticker string, mic string, country string, enabled boolean, requires_listing boolean, checked_at date, valid_until date"
US_SYMBOLS = "symbol string, description string, type string, mic string, currency string, figi string, shareClassFIGI string"
CATALOGUE_CSV = "ticker string, company_name string, sector string, country string, is_us_listed string, exchange_hint string"
SNAPSHOT = "ticker string, company_name string, country string, exchange_hint string, resolution_status string, resolution_note string, exchange_code string, mic string, symbol string, symbol_format string, security_kind string, listing_country string, currency string, figi string, share_class_figi string, is_us boolean, is_primary boolean, confidence double, source string, resolved_at string"
QUOTES = "timestamp bigint, longPrice double, shortPrice double"
BOOK = "bids array<struct<px:struct<value:string,currency:string>,qty:string>>, offers array<struct<px:struct<value:string,currency:string>,qty:string>>"

ENTITIES = {k.lower(): v for k, v in dict(globals()).items() if k.isupper() and isinstance(v, str) and " " in v}
