"""Job-market views over the supplied tables.

Each view is one SQL text that Spark and DuckDB both run. ``HASH(`` and ``TS '``
stand for the one function and the one literal that the two spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from jobloom.functions import rules

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: The names of the technology table, one for each of its first thirty rules.
TECHS = list(rules.TECH_PATTERNS)[:30]

_VACANCY_FACTS = """
  o.o_orderkey AS vacancy_id, o.o_custkey AS company_id,
  CASE o.o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'filled' ELSE 'inactive' END AS status,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'lead' WHEN '2-HIGH' THEN 'senior' WHEN '3-MEDIUM' THEN 'mid'
    WHEN '5-LOW' THEN 'junior' ELSE 'not_specified' END AS experience_level,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' ELSE 'on-site' END AS work_model,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'София' WHEN 1 THEN 'Plovdiv' WHEN 2 THEN 'Varna'
    WHEN 3 THEN 'Remote' WHEN 4 THEN 'Пловдив' ELSE 'Sofia, Bulgaria' END AS location,
  'site' || CAST(o.o_orderkey % 4 AS VARCHAR(8)) AS source_site,
  'https://site' || CAST(o.o_orderkey % 4 AS VARCHAR(8)) || '.example.org/company/jobads/firm'
    || CAST(o.o_custkey AS VARCHAR(12)) || '-' || CAST(o.o_orderkey AS VARCHAR(12)) || '/' AS source_url,
  CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE CAST(1000 + o.o_orderkey * 7 % 6000 AS INT) END AS salary_min,
  CASE WHEN o.o_orderkey % 10 IN (0, 1) THEN NULL
    ELSE CAST(2000 + o.o_orderkey * 7 % 6000 + o.o_orderkey % 1500 AS INT) END AS salary_max,
  CASE WHEN o.o_orderkey % 5 = 0 THEN 'EUR' ELSE 'BGN' END AS currency,
  CASE WHEN o.o_orderkey % 8 = 0 THEN NULL ELSE CAST(o.o_orderkey * 31 % 101 AS INT) END AS extraction_confidence,
  CASE WHEN o.o_orderkey % 8 = 0 THEN NULL ELSE CAST(o.o_orderkey * 17 % 101 AS INT) END AS quality_score,
  CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL '60' DAY END AS expires_at,
  o.o_orderdate AS created_at"""

VIEWS: dict[str, str] = {
    "companies": """
SELECT c.c_custkey AS company_id, c.c_name AS name,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Consulting' WHEN 'AUTOMOBILE' THEN 'Gaming'
    WHEN 'MACHINERY' THEN 'Financial Technology' WHEN 'HOUSEHOLD' THEN 'Healthcare' ELSE 'Technology' END AS industry,
  CASE c.c_custkey % 5 WHEN 0 THEN 'startup' WHEN 1 THEN 'small' WHEN 2 THEN 'medium' WHEN 3 THEN 'large'
    ELSE 'enterprise' END AS size,
  n.n_name AS location, c.c_mktsegment || ' supplier in ' || n.n_name AS description,
  'https://www.firm' || CAST(c.c_custkey AS VARCHAR(12)) || '.example.com' AS website,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(1980 + c.c_custkey % 45 AS INT) END AS founded,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE CAST(c.c_custkey * 13 % 2000 AS INT) END AS employee_count
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "vacancies": f"""
SELECT {_VACANCY_FACTS}, p.p_name AS title, p.p_type || ' ' || p.p_brand AS description
FROM orders o
LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
LEFT JOIN part p ON p.p_partkey = l.pk""",
    "postings": """
SELECT vacancy_id, company_id, status, title, description, created_at FROM vacancies
UNION ALL
SELECT vacancy_id + 1000000000 AS vacancy_id, company_id, status,
  CASE vacancy_id % 4 WHEN 0 THEN substr(title, instr(title, ' ') + 1) || ' (' || substr(title, 1, instr(title, ' ') - 1) || ')'
    WHEN 1 THEN title || ' senior' WHEN 2 THEN 'Clerk' ELSE title END AS title,
  CASE vacancy_id % 4 WHEN 3 THEN 'Work from any place you like' ELSE description END AS description,
  created_at + INTERVAL '10' DAY AS created_at
FROM vacancies WHERE vacancy_id % 5 < 2""",
    "vacancy_facts": f"SELECT {_VACANCY_FACTS} FROM orders o",
    "vacancy_tech": "SELECT DISTINCT l.l_orderkey AS vacancy_id, CASE p_partkey % 30 "
    + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TECHS))
    + " END AS tech FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey",
    "company_analyses": """
SELECT event_id AS analysis_id, user_id AS company_id, event_type AS analysis_source,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id * 37 % 101) / 10.0E0 END AS recommendation_score,
  (event_id * 53 % 101) / 10.0E0 AS culture_score, (event_id * 71 % 101) / 10.0E0 AS work_life_balance,
  (event_id * 29 % 101) / 10.0E0 AS career_growth, (event_id * 17 % 101) / 10.0E0 AS tech_culture,
  CAST(event_id * 43 % 101 AS INT) AS confidence_score,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE '["Pay","Team","Office ' || CAST(event_id % 5 AS VARCHAR(2)) || '","Training"]' END AS pros,
  CASE WHEN event_id % 8 = 0 THEN '["broken' ELSE '["Pace","Meetings","Tools"]' END AS cons,
  '["java","aws","kafka","react","git","docker"]' AS tech_stack,
  '["Openness","Craft","Trust","Care"]' AS company_values,
  '{"contactEmail": "hr' || CAST(event_id AS VARCHAR(12)) || '@example.com", "address": "Street ' || CAST(event_id % 90 AS VARCHAR(4))
    || '", "companyType": ' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE '"product"' END || '}' AS raw_data,
  ts AS created_at
FROM events WHERE event_type IN ('view', 'click', 'signup')""",
    "applications": """
SELECT event_id AS application_id, event_id % 1000 AS vacancy_id, user_id AS cv_id,
  CASE event_type WHEN 'purchase' THEN 'offered' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'applied'
    WHEN 'click' THEN 'interviewing' ELSE 'draft' END AS status,
  CASE WHEN event_type = 'view' THEN NULL ELSE ts END AS applied_at, ts AS created_at
FROM events""",
    "cvs": """
SELECT DISTINCT user_id AS cv_id, 'cv' || CAST(user_id AS VARCHAR(12)) || '.pdf' AS filename,
  CAST(user_id % 16 AS INT) AS experience FROM events WHERE user_id % 4 <> 3""",
    "vacancy_scores": """
SELECT event_id AS score_id, event_id * 7 % 1500 AS vacancy_id, CAST(event_id * 37 % 101 AS INT) AS overall_score,
  ts AS scored_at FROM events WHERE event_type = 'click'""",
    "company_sources": """
SELECT page_id AS source_id, page_id % 100 AS company_id,
  regexp_extract(url, '^https?://([^/]+)', 1) AS source_site, url AS source_url, html AS scraped_content,
  page_id % 9 <> 0 AS is_valid, TS '2024-01-01 00:00:00' + page_id * INTERVAL '1' HOUR AS last_scraped_at
FROM pages""",
    "scoring_inputs": """
SELECT company_id, name, industry, size, founded, employee_count,
  split(CASE company_id % 4 WHEN 0 THEN 'React,Node.js,TypeScript,Docker,Kubernetes,AWS' WHEN 1 THEN 'Java,Spring,PostgreSQL,Kafka'
    WHEN 2 THEN 'Go,Rust,GraphQL,serverless,GitHub' ELSE 'PHP,Jenkins,monitoring' END, ',') AS technologies,
  split(CASE company_id % 5 WHEN 0 THEN 'Health insurance,Stock options,Conference budget' WHEN 1 THEN 'Flexible hours,Remote work,Training,Unlimited vacation'
    WHEN 2 THEN 'Dental,Wellness,Gym,Free lunch,No overtime' WHEN 3 THEN 'Bonus,Career path,Mentorship,25 days annual leave' ELSE 'Parking' END, ',') AS benefits,
  split(CASE company_id % 3 WHEN 0 THEN 'Innovation,Learning,Open communication' WHEN 1 THEN 'Agile,Testing,Teamwork,Leadership' ELSE 'Integrity' END, ',') AS company_values,
  CAST(company_id % 5 AS INT) AS award_count,
  CASE company_id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'office' END AS work_model,
  CAST(company_id % 15 AS INT) AS job_openings, CAST(company_id * 7 % 101 AS INT) AS data_completeness, 85 AS source_reliability
FROM companies""",
    "replies": """
SELECT doc_id AS reply_id, text_hash AS content_hash, TS '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR AS computed_at,
  CASE WHEN doc_id % 17 = 0 THEN '{"title": "broken' ELSE
    '{"title": ' || CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE '"Job ' || CAST(doc_id AS VARCHAR(12)) || '"' END ||
    ', "technologies": ["java", "aws"], "salaryMin": ' || CAST(doc_id % 9 * 500 AS VARCHAR(12)) ||
    ', "confidenceScore": ' || CAST(doc_id * 37 % 121 AS VARCHAR(12)) || ', "qualityScore": ' || CAST(doc_id * 41 % 101 AS VARCHAR(12)) || '}' END AS reply
FROM (SELECT doc_id, HASH(text) AS text_hash FROM documents) d""",
    "listings": """
SELECT vacancy_id AS listing_id, source_site AS run_id,
  CASE WHEN vacancy_id % 7 = 0 THEN title || ' new' WHEN vacancy_id % 41 = 0 THEN NULL ELSE title END AS title,
  CASE WHEN vacancy_id % 50 = 0 THEN company_id + 100000 ELSE company_id END AS company_id,
  CASE WHEN vacancy_id % 29 = 0 THEN '' WHEN vacancy_id % 31 = 0 THEN NULL WHEN vacancy_id % 3 = 0 THEN source_url || '?v=2' ELSE source_url END AS url,
  CASE WHEN vacancy_id % 4 = 0 THEN NULL WHEN vacancy_id % 4 = 1 THEN CAST(1000 + vacancy_id % 900 AS VARCHAR(8)) || ' BGN'
    ELSE '3000-' || CAST(5000 + vacancy_id % 900 AS VARCHAR(8)) || ' BGN' END AS salary_range,
  work_model, location, source_site, created_at + INTERVAL '30' DAY AS posted_at
FROM vacancies""",
    "cards": """
SELECT o_orderkey AS card_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'Старши Java Разработчик' WHEN 1 THEN 'Младши ПРОГРАМИСТ (React)'
    WHEN 2 THEN 'Lead Backend Developer' WHEN 3 THEN 'Фулстак инженер' WHEN 4 THEN 'Graduate QA' ELSE 'Mid-level Programmer' END
    || ' ' || CAST(o_orderkey AS VARCHAR(12)) AS title,
  CASE o_orderkey % 5 WHEN 0 THEN chr(10) || '  София ' || chr(10) || 'Хибридно' WHEN 1 THEN 'Fully Remote' WHEN 2 THEN 'Дистанционно'
    WHEN 3 THEN ' ' ELSE 'Burgas' || chr(10) || 'On-site' END AS badge,
  CASE o_orderkey % 5 WHEN 0 THEN 'Хибридно' WHEN 1 THEN 'Remote' WHEN 2 THEN 'В офиса' WHEN 3 THEN 'Дистанционно' ELSE 'contract' END AS model_text,
  CASE WHEN o_orderkey % 9 = 0 THEN 'no date here' ELSE 'Публикувана ' || CAST(1 + o_orderkey % 31 AS VARCHAR(4)) || ' ' ||
    CASE o_orderkey % 12 WHEN 0 THEN 'януари' WHEN 1 THEN 'февруари' WHEN 2 THEN 'Март' WHEN 3 THEN 'април' WHEN 4 THEN 'май'
      WHEN 5 THEN 'юни' WHEN 6 THEN 'ЮЛИ' WHEN 7 THEN 'август' WHEN 8 THEN 'септември' WHEN 9 THEN 'октомври'
      WHEN 10 THEN 'ноември' ELSE 'декември' END || ' г.' END AS posted_text,
  CASE o_orderkey % 3 WHEN 0 THEN '2001-0' || CAST(1 + o_orderkey % 9 AS VARCHAR(2)) || '-1' || CAST(o_orderkey % 7 AS VARCHAR(2)) || ' 08:30:00'
    WHEN 1 THEN 'soon' END AS posted_attr,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(1000 + o_orderkey % 900 AS VARCHAR(8)) || ' BGN'
    WHEN 2 THEN 'Competitive' ELSE CAST(2000 + o_orderkey % 900 AS VARCHAR(8)) || ' - ' || CAST(5000 + o_orderkey % 900 AS VARCHAR(8)) || ' BGN' END AS salary_range,
  '<p>Заплата: <b>' || CASE o_orderkey % 6 WHEN 0 THEN '4 500 - ' || CAST(5000 + o_orderkey % 900 AS VARCHAR(8)) || ' лв'
    WHEN 1 THEN 'От 5000 до ' || CAST(6000 + o_orderkey % 900 AS VARCHAR(8)) || ' лева' WHEN 2 THEN 'up to ' || CAST(7000 + o_orderkey % 900 AS VARCHAR(8)) || ' BGN'
    WHEN 3 THEN 'до 9 500 лв' WHEN 4 THEN 'Net Monthly: 4,500-9,500 bgn' ELSE 'по договаряне' END || '</b></p>' AS salary_html,
  CASE o_orderkey % 11 WHEN 0 THEN '1-10' WHEN 1 THEN '11-50 employees' WHEN 2 THEN '51-200' WHEN 3 THEN '201-500' WHEN 4 THEN '501-1000'
    WHEN 5 THEN '1000+' WHEN 6 THEN 'Startup' WHEN 7 THEN 'Large (500+)' WHEN 8 THEN '201-1000 people' WHEN 9 THEN NULL ELSE 'enterprise' END AS size_text,
  TS '2001-09-01 00:00:00' + (o_orderkey % 15 - 4) * INTERVAL '1' DAY - (o_orderkey % 3) * INTERVAL '5' HOUR AS deadline,
  TS '2001-09-01 00:00:00' - (o_orderkey % 45) * INTERVAL '1' DAY - (o_orderkey % 3) * INTERVAL '5' HOUR AS shown_at
FROM orders""",
    "extractions": """
SELECT doc_id AS reply_id, '{"title": ' || CASE WHEN doc_id % 5 = 0 THEN 'null' WHEN doc_id % 13 = 0 THEN '7' ELSE '"Job ' || CAST(doc_id AS VARCHAR(12)) || '"' END
  || ', "description": "' || CASE WHEN doc_id % 3 = 0 THEN 'short' ELSE 'a long description that surely goes past fifty characters in all' END || '"'
  || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ', "requirements": ["java", "sql"]' END
  || CASE WHEN doc_id % 6 = 0 THEN ', "technologies": []' ELSE ', "technologies": ["java", "aws"]' END
  || CASE WHEN doc_id % 7 = 0 THEN ', "location": "Sofia", "experienceLevel": "senior"' ELSE '' END
  || CASE WHEN doc_id % 19 = 0 THEN ', "mood": "good"' ELSE '' END
  || ', "salaryMin": ' || CAST(doc_id % 9 * 500 AS VARCHAR(12))
  || ', "confidenceScore": ' || CAST(doc_id * 37 % 121 AS VARCHAR(12))
  || CASE WHEN doc_id % 23 = 0 THEN '' ELSE ', "qualityScore": ' || CAST(doc_id * 41 % 101 AS VARCHAR(12)) END
  || CASE WHEN doc_id % 10 = 0 THEN '' ELSE ', "extractionMetadata": {"sourceType": "' || CASE doc_id % 3 WHEN 0 THEN 'job_board' WHEN 1 THEN 'other' ELSE 'radio' END
    || '", "contentLength": ' || CAST(doc_id % 8 * 100 AS VARCHAR(12)) || ', "hasStructuredData": true, "language": "'
    || CASE WHEN doc_id % 11 = 0 THEN 'english' ELSE lang END || '"}' END || '}' AS reply
FROM documents""",
    "link_samples": """
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://dev.bg/company/firm-' || CAST(page_id AS VARCHAR(12)) || '/' WHEN 1 THEN 'https://dev.bg/company/jobs/java/'
    WHEN 2 THEN 'ftp://files.example.org/x' WHEN 3 THEN 'https://www.LinkedIn.com/company/x' WHEN 4 THEN 'not a url' ELSE url END AS link,
  CASE page_id % 7 WHEN 0 THEN 'DEV.BG Careers' WHEN 1 THEN 'Dice' WHEN 2 THEN ' ' WHEN 3 THEN 'Acme & Sons, Ltd.' WHEN 4 THEN 'monster'
    WHEN 5 THEN NULL ELSE 'Firm ' || CAST(page_id AS VARCHAR(12)) END AS new_name,
  CASE page_id % 5 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN '' ELSE 'Old ' || CAST(page_id AS VARCHAR(12)) END AS old_name,
  'https://dev.bg/company/jobads/' || CASE page_id % 6 WHEN 0 THEN 'technologica-senior-java-developer' WHEN 1 THEN 'senior-java-developer'
    WHEN 2 THEN 'recruitment-bg-middle' WHEN 3 THEN 'ab-cd-ef' WHEN 4 THEN 'java' ELSE 'firm' || CAST(page_id AS VARCHAR(12)) || '-dev' END || '/' AS job_url
FROM pages""",
    "company_pages": """
SELECT company_id, '<html><head><title>' || name || ' - Dev.bg</title></head><body><div class="company-header"><h1 class="company-name">' ||
  CASE WHEN company_id % 6 = 0 THEN 'dev.bg' ELSE name END || '</h1></div><div class="company-description"><p>A ' || size || ' firm.</p></div>' ||
  CASE WHEN company_id % 2 = 0 THEN '<div class="company-logo"><img src="//cdn.example.org/' || CAST(company_id AS VARCHAR(12)) || '.png"></div>' ELSE '' END ||
  '<a href="https://www.linkedin.com/company/f' || CAST(company_id AS VARCHAR(12)) || '">in</a>' || CASE WHEN company_id % 7 = 0 THEN '' ELSE '<a href="https://github.com/f">code</a>' END ||
  CASE WHEN company_id % 3 = 0 THEN '<a href="https://f' || CAST(company_id AS VARCHAR(12)) || '.example.com">Website</a>' ELSE '' END ||
  CASE WHEN company_id % 4 = 0 THEN '<div class="headquarters">Headquarters: Varna, BG</div>' ELSE '<div class="location">Plovdiv</div>' END ||
  '<div class="facts">Founded: ' || coalesce(CAST(founded AS VARCHAR(4)), 'long ago') || '. Worldwide team: ' || CAST(1000 + company_id AS VARCHAR(12)) ||
  ' people. Bulgaria: ' || CAST(company_id % 90 AS VARCHAR(12)) || '; Engineering: ' || CAST(company_id % 40 AS VARCHAR(12)) || '.</div>' ||
  CASE WHEN company_id % 5 = 0 THEN '<div class="industry">' || industry || '</div>' WHEN company_id % 5 = 1 THEN '<p>We do banking software.</p>' ELSE '' END ||
  CASE WHEN company_id % 3 = 1 THEN '<div class="job-count">We have ' || CAST(job_openings AS VARCHAR(4)) || ' jobs</div>'
    ELSE '<a href="/job/1">one</a><a href="/vacancy/2">two</a>' END ||
  '<ul class="technologies">' || CASE company_id % 4 WHEN 0 THEN '<li>React</li><li>Node.js</li><li>AWS</li>' WHEN 1 THEN '<li>Java</li><li>Kafka</li><li>Java</li>'
    WHEN 2 THEN '<li>Go</li><li>C</li>' ELSE '' END || '</ul><ul class="benefits">' || CASE company_id % 3 WHEN 0 THEN '<li>Health insurance</li><li>Free lunch</li>'
    WHEN 1 THEN '<li>Remote work</li>' ELSE '' END || '</ul><ul class="values"><li>Craft</li><li>Joy</li><li>Trust</li></ul><ul class="awards">' ||
  CASE WHEN company_id % 2 = 0 THEN '<li>Fast grower</li>' ELSE '' END || '</ul><p>Best Employer of 2020. Winner in ' || industry || '.</p><p>' ||
  CASE company_id % 4 WHEN 0 THEN 'Fully remote, flexible hours' WHEN 1 THEN 'A hybrid place, core hours' WHEN 2 THEN 'On-site, 9 to 5' ELSE 'Come and see' END ||
  '</p><p>Write to hr' || CAST(company_id AS VARCHAR(12)) || '@example.com</p><div class="address">12 Main Street, Sofia</div></body></html>' AS html
FROM scoring_inputs""",
    "info_pages": """
SELECT company_id, '<html><head><title>' || name || ' - dev.bg</title></head><body>' ||
  CASE WHEN company_id % 7 = 0 THEN '' ELSE '<div class="awards-section"><span class="award">Best 2023</span></div>' END ||
  '<div class="tech-stack"><div class="tech-tags"><span class="tech-tag">Redis</span>' ||
  CASE WHEN company_id % 2 = 0 THEN '<img title="Scala" src="s.png">' ELSE '<span class="tech-tag">Go</span>' END || '</div></div>' ||
  '<div class="job-openings"><div class="job-item">a</div><div class="job-item">b</div></div><div class="company-info">' ||
  CASE WHEN company_id % 4 = 0 THEN '' ELSE '<div class="info-item"><span class="label">Location:</span><span class="value">Varna</span></div>' END ||
  '<div class="info-item"><span class="label">Founded:</span><span class="value">' || coalesce(CAST(founded AS VARCHAR(4)), '') || '</span></div>' ||
  '<div class="info-item"><span class="label">Size:</span><span class="value">' || CASE company_id % 3 WHEN 0 THEN '201-500 employees' WHEN 1 THEN '11-50' ELSE 'Startup' END ||
  '</span></div>' || CASE WHEN company_id % 5 = 0 THEN '' ELSE '<div class="info-item"><span class="label">Industry:</span><span class="value">' || industry || '</span></div>' END ||
  '</div><div class="company-values"><ul><li>Care</li></ul></div><div class="benefits-section"><ul class="benefits-list"><li>Bonus</li><li>Gym</li></ul></div>' ||
  '<h1 class="company-name">' || name || chr(10) || ' more</h1><div class="company-description"><p>A ' || size || ' team.</p></div></body></html>' AS html
FROM scoring_inputs""",
    "listing_pages": """
SELECT p_partkey AS page_id, '<html><body><div class="job-list-item"><h6 class="job-title">' || CASE p_partkey % 4 WHEN 0 THEN 'Старши Java Разработчик' WHEN 1 THEN 'Младши програмист'
    ELSE p_name || ' Developer' END || '</h6><span class="company-name">Firm ' || CAST(p_partkey % 50 AS VARCHAR(12)) || '</span><a class="overlay-link" href="/company/jobads/firm'
  || CAST(p_partkey AS VARCHAR(12)) || '/"></a><span class="badge">' || CASE p_partkey % 3 WHEN 0 THEN 'София' || chr(10) || 'Хибридно' WHEN 1 THEN 'Fully Remote' ELSE 'Burgas' END || '</span>' ||
  CASE WHEN p_partkey % 2 = 0 THEN '<span class="salary">' || CAST(2000 + p_partkey % 900 AS VARCHAR(12)) || '-5000 BGN</span>' ELSE '' END ||
  CASE p_partkey % 3 WHEN 0 THEN '<time datetime="2001-03-0' || CAST(1 + p_partkey % 9 AS VARCHAR(2)) || ' 10:00:00">скоро</time>' WHEN 1 THEN '<time>Публикувана 5 март</time>' ELSE '' END ||
  '<img title="Docker "><img title="docker"><img title="' || p_brand || '"><img src="x.png"></div><div class="job-list-item"><h6 class="job-title">Nameless</h6></div>' ||
  CASE WHEN p_partkey % 5 = 0 THEN '<div class="job-list-item"><div class="job-title">QA</div><div class="company-name">Second</div></div>' ELSE '' END || '</body></html>' AS html
FROM part""",
    "known_companies": """
SELECT 'c' || CAST(company_id AS VARCHAR(12)) AS company_id, 'Firm ' || CAST(company_id AS VARCHAR(12)) AS name, industry
FROM companies WHERE company_id < 50 AND company_id % 2 = 0""",
    "known_vacancies": """
SELECT 'v' || CAST(p_partkey AS VARCHAR(12)) AS vacancy_id, CASE p_partkey % 3 WHEN 0 THEN 'Old title' ELSE 'Senior Java Developer' END AS title,
  'c' || CAST(p_partkey % 50 AS VARCHAR(12)) AS company_id, 'filled' AS status,
  CASE p_partkey % 3 WHEN 0 THEN '/company/jobads/firm' || CAST(p_partkey AS VARCHAR(12)) || '/' ELSE 'gone ' || CAST(p_partkey AS VARCHAR(12)) END AS source_url
FROM part WHERE p_partkey % 5 = 0""",
    "known_sources": """
SELECT company_id AS source_id, 'c' || CAST(company_id AS VARCHAR(12)) AS company_id, 'dev.bg' AS source_site, 'https://dev.bg/company/' || CAST(company_id AS VARCHAR(12)) || '/' AS source_url,
  company_id % 8 <> 0 AS is_valid, TS '2001-08-20 00:00:00' + company_id * INTERVAL '6' HOUR AS last_scraped_at
FROM companies WHERE company_id < 50 AND company_id % 4 = 0""",
    "job_pages": """
SELECT page_id, '<html><body><a href="/company/jobs/java/">all</a>' || CASE page_id % 4 WHEN 0 THEN '<a href="/company/firm-' || CAST(page_id AS VARCHAR(12)) || '/">Firm</a>'
    WHEN 1 THEN '<a href="https://dev.bg/company/acme/">Acme</a>' ELSE '' END || CASE page_id % 3 WHEN 0 THEN '<a href="https://first' || CAST(page_id AS VARCHAR(12)) ||
    '.example.com/x">Home</a><a href="https://second.example.org">Our website</a>' WHEN 1 THEN '<a href="https://www.linkedin.com/in/x">li</a><p>see http://plain' ||
    CAST(page_id AS VARCHAR(12)) || '.example.net/about</p>' ELSE '<p>nothing</p>' END || '<div class="job-description"> <b>Build</b> things ' || CAST(page_id AS VARCHAR(12)) ||
  '</div><div class="x job-requirements"><i>Java</i> and SQL</div>' || html || '</body></html>' AS html, 'Firm & Co ' || CAST(page_id AS VARCHAR(12)) AS company FROM pages""",
    "request_logs": """
SELECT event_id AS log_id, ts AS logged_at, event_type AS method, event_id * 13 % 900 AS total_tokens,
  event_id * 7 % 5000 AS duration, event_type = 'error' AS failed, CAST(event_id * 43 % 101 AS INT) AS confidence,
  event_id % 3 = 0 AS cache_hit FROM events""",
    "scrape_runs": """
SELECT l_suppkey AS run_id, 'site' || CAST(l_suppkey % 4 AS VARCHAR(8)) AS source_site,
  CASE l_suppkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS status,
  count(*) AS vacancies_found, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS vacancies_new,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS vacancies_updated
FROM lineitem GROUP BY l_suppkey""",
}


def _names_in(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One supplied table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, dealt: str | None = None) -> DataFrame:
    """One derived view as a DataFrame; nothing is registered in the session.

    ``dealt`` names a table or view below it whose rows are dealt out to all cores.
    """
    text = VIEWS[name]
    parts: dict[str, DataFrame] = {}
    for table in _names_in(text, TABLES):
        parts[table] = load(spark, sf_dir, table)
    for other in _names_in(text, VIEWS):
        parts[other] = view(spark, sf_dir, other, dealt)
    if dealt in parts:
        parts[dealt] = deal(parts[dealt])
    text = re.sub(r"\bHASH\((\w+)\)", r"sha2(\1, 256)", text).replace("TS '", "TIMESTAMP_NTZ '")
    text = text.replace("{", "{{").replace("}", "}}")
    for name_ in parts:
        text = re.sub(rf"\b(FROM|JOIN)\s+{name_}\b", rf"\1 {{{name_}}}", text)
    return spark.sql(text, **parts)


#: Session setting: partitions that inputs are dealt out to before heavy per-row work; unset, they keep their own.
PARTITIONS = "spark.jobloom.inputPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal an input out to a fixed number of partitions, where the session names one.

    A single small file is a single task. A local session for tests and benches asks for its
    cores; on a cluster, where files are many, nothing is set and nothing is shuffled.
    """
    parts = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


#: Tasks a core for rows that are dealt out before they grow.
TASKS_A_CORE = 4


def deal(df: DataFrame) -> DataFrame:
    """Deal small rows out to all cores before each of them becomes a page.

    A file of a few MB holds the rows of a GB of pages, and its size alone decides on its tasks:
    without this all of them are made and read in one. Executors that are still to come do not
    count as cores, so there are never fewer tasks than shuffle partitions.
    """
    spark = df.sparkSession
    parts = spark.conf.get(PARTITIONS, None)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(int(parts) if parts else max(TASKS_A_CORE * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def duckdb_sql(query: str) -> str:
    """Put the views a query names in front of it as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _names_in(text, VIEWS):
            if name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(query)
    ctes = [
        f"{n} AS ({VIEWS[n].replace('HASH(', 'sha256(').replace(chr(84) + 'S ' + chr(39), 'TIMESTAMP ' + chr(39))})"
        for n in needed
    ]
    body = query.strip()
    if not ctes:
        return body
    recursive = ""
    if re.match(r"(?i)WITH\s+RECURSIVE\b", body):
        recursive, body = "RECURSIVE ", re.sub(r"(?i)^WITH\s+RECURSIVE\b", "WITH", body)
    if re.match(r"(?i)WITH\b", body):
        return f"WITH {recursive}" + ",\n".join(ctes) + ",\n" + re.sub(r"(?i)^WITH\b", "", body, count=1)
    return "WITH " + ",\n".join(ctes) + "\n" + body
