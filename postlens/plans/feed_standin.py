"""Feed payloads made of the documents table, one a feed, so that each parser is run on a whole table. The fields are those that the public feeds send."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that a payload spans: about twenty documents of a company.
PAGE = 400
ISO = "date_format(timestamp_seconds(1700000000 + doc_id * 1000), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
HTML = "concat('<p>Work on ', source, ' &amp; ', lang, '.</p><ul><li>one</li><li>two</li></ul><script>no()</script>')"
ESCAPED = f"replace(replace(replace({HTML}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
TITLE, URL = "concat('Role ', doc_id)", "concat('https://jobs.example/', doc_id)"

#: feed -> (the item as a Spark struct, the payload around the list of items)
FEEDS = {
    "greenhouse": (f"""named_struct('id', doc_id, 'title', {TITLE}, 'absolute_url', {URL}, 'content', {ESCAPED}, 'first_published', if(doc_id % 3 = 0, null, {ISO}), 'updated_at', {ISO}, 'company_name', 'unused',
        'location', named_struct('name', if(doc_id % 2 = 0, 'Berlin; Paris', 'Oslo|Rome ')), 'offices', array(named_struct('name', 'Berlin'), named_struct('name', lang)), 'departments', array(named_struct('name', 'Data'), named_struct('name', source)))""", '{"jobs": %s}'),
    "lever": (f"""named_struct('id', cast(doc_id as string), 'text', {TITLE}, 'hostedUrl', if(doc_id % 2 = 0, {URL}, ''), 'applyUrl', concat({URL}, '/apply'), 'descriptionPlain', if(doc_id % 2 = 0, 'Plain text.', ''), 'description', {HTML}, 'additionalPlain', if(doc_id % 5 = 0, 'More.', ''),
        'workplaceType', element_at(array('remote', 'hybrid', 'on-site', 'unspecified'), cast(doc_id % 4 as int) + 1), 'createdAt', (1700000000 + doc_id * 1000) * 1000, 'categories', named_struct('location', 'Oslo', 'allLocations', array('Oslo', lang), 'department', if(doc_id % 3 = 0, '', 'Data'), 'commitment', 'Full-time', 'team', 'Team'))""", "%s"),
    "ashby": (f"""named_struct('id', cast(doc_id as string), 'title', {TITLE}, 'isListed', if(doc_id % 7 = 0, false, if(doc_id % 7 = 1, null, true)), 'location', 'Rome', 'secondaryLocations', array(named_struct('location', 'Milan'), named_struct('location', lang)), 'isRemote', if(doc_id % 2 = 0, null, doc_id % 3 = 0), 'workplaceType', if(doc_id % 4 = 0, 'Remote', 'OnSite'),
        'jobUrl', {URL}, 'applyUrl', 'x', 'descriptionPlain', if(doc_id % 2 = 0, 'Plain.', null), 'descriptionHtml', {HTML}, 'department', null, 'team', source, 'employmentType', 'FullTime', 'publishedAt', {ISO}, 'updatedAt', {ISO})""", '{"jobs": %s}'),
    "workable": (f"""named_struct('shortcode', if(doc_id % 2 = 0, concat('S', doc_id), ''), 'id', cast(doc_id as string), 'title', {TITLE}, 'url', {URL}, 'location', named_struct('city', 'Izmir', 'region', '', 'country', 'Turkey'),
        'locations', array(named_struct('city', 'Lyon', 'region', 'ARA', 'country', 'France', 'hidden', doc_id % 3 = 0)), 'remote', if(doc_id % 4 = 0, null, doc_id % 4 = 1), 'workplace', if(doc_id % 8 = 0, 'remote', 'on_site'), 'department', if(doc_id % 2 = 0, '["A", "B"]', 'C'), 'published', if(doc_id % 5 = 0, '', {ISO}), 'created_at', {ISO}, 'description', {HTML}, 'type', 'full')""", '{"results": %s}'),
    "smartrecruiters": (f"""named_struct('id', cast(doc_id as string), 'name', {TITLE}, 'applyUrl', {URL}, 'jobAd', 'Plain ad.', 'location', named_struct('city', 'Bonn', 'region', 'NRW', 'country', lang, 'remote', doc_id % 2 = 0), 'department', named_struct('label', 'Ops'), 'typeOfEmployment', named_struct('label', 'Permanent'), 'releasedDate', {ISO})""", '{"content": %s, "totalFound": 1}'),
    "remotive": (f"""named_struct('id', doc_id, 'title', {TITLE}, 'company_name', source, 'url', {URL}, 'candidate_required_location', if(doc_id % 2 = 0, 'USA, Canada', ''), 'description', {HTML}, 'category', 'Data', 'job_type', 'contract', 'publication_date', {ISO}, 'salary', '$1', 'tags', array('a', lang))""", '{"jobs": %s}'),
    "remoteok": (f"""named_struct('id', if(doc_id % 6 = 0, '', cast(doc_id as string)), 'position', {TITLE}, 'company', source, 'location', 'Rome, Milan', 'url', '', 'apply_url', {URL}, 'description', {HTML}, 'tags', array('a', lang), 'date', {ISO}, 'salary_min', if(doc_id % 2 = 0, 10, 0), 'salary_max', 20)""", "%s"),
    "arbeitnow": (f"""named_struct('slug', concat('s-', doc_id), 'title', {TITLE}, 'company_name', source, 'location', 'Munich', 'url', {URL}, 'remote', doc_id % 2 = 0, 'description', {HTML}, 'tags', array(lang), 'job_types', array('full', 'part'), 'created_at', 1700000000 + doc_id * 1000)""", '{"data": %s}'),
    "themuse": (f"""named_struct('id', doc_id, 'name', {TITLE}, 'contents', {HTML}, 'company', named_struct('name', source), 'locations', array(named_struct('name', if(doc_id % 2 = 0, 'Flexible / Remote', 'Rome'))), 'categories', array(named_struct('name', 'Data')), 'levels', array(named_struct('name', 'Senior')), 'refs', named_struct('landing_page', {URL}), 'publication_date', {ISO})""", '{"results": %s}'),
    "himalayas": (f"""named_struct('guid', concat('g', doc_id), 'title', {TITLE}, 'companyName', source, 'applicationLink', {URL}, 'locationRestrictions', array('Spain', '', lang), 'description', {HTML}, 'categories', array('x', 'y'), 'employmentType', 'Full Time', 'pubDate', 1700000000 + doc_id * 1000, 'expiryDate', 1800000000, 'minSalary', if(doc_id % 2 = 0, 5, 0), 'maxSalary', 9, 'currency', 'EUR')""", '{"jobs": %s}'),
    "jobicy": (f"""named_struct('id', doc_id, 'jobTitle', {TITLE}, 'companyName', source, 'url', {URL}, 'jobGeo', 'USA,  Canada', 'jobDescription', {HTML}, 'jobIndustry', array('i'), 'jobType', array('full', 'part'), 'jobLevel', 'Mid', 'pubDate', {ISO})""", '{"jobs": %s}'),
}
RSS = "concat('<item><title><![CDATA[', source, if(doc_id % 5 = 0, '', concat(': Role ', doc_id)), ']]></title><link>', 'https://jobs.example/', doc_id, '</link><region>Anywhere</region><category>Code</category><description>&lt;p&gt;Work on ', source, '.&lt;/p&gt;</description><pubDate>', date_format(timestamp_seconds(1700000000 + doc_id * 1000), 'EEE, dd MMM yyyy HH:mm:ss'), ' +0000</pubDate></item>')"
CARD = "concat('<a class=\"k\" href=\"/is-ilani/', doc_id % 700, '?from=list\"><span data-test=\"ad-title\">Role <b>', doc_id % 700, '</b></span><span data-test=\"subtitle\">', source, '</span><span data-test=\"location\">Izmir, Ankara</span><span data-test=\"work-model\">', element_at(array('Uzaktan', 'Hibrit', ''), cast(doc_id % 3 as int) + 1), '</span><span data-test=\"work-type\">Tam Zamanlı</span><span data-test=\"ad-date\">', element_at(array('2 hafta önce', '3 gün önce', 'Bugün', 'yeni'), cast(doc_id % 4 as int) + 1), '</span></a>')"
LD = f"""concat('<script type="application/ld+json">{{"@type": "WebSite"}}</script><p>x</p><script type="application/ld+json">', to_json(named_struct('@type', 'JobPosting', 'title', {TITLE}, 'url', {URL}, 'description', replace({HTML}, '<script>no()</script>', ''), 'employmentType', 'FULL_TIME', 'datePosted', '2024-01-05', 'validThrough', '2024-03-05', 'hiringOrganization', named_struct('name', source), 'baseSalary', named_struct('value', named_struct('value', 100)))), '</script>')"""


def payloads(docs: DataFrame, feed: str) -> DataFrame:
    """token, company, payload: a company's documents in pages that span PAGE ids."""
    item, around = FEEDS[feed]
    before, after = around.split("%s")
    rows = docs.select("source", F.floor(F.col("doc_id") / PAGE).alias("page"), F.expr(item).alias("item"))
    return rows.groupBy("source", "page").agg(F.concat(F.lit(before), F.to_json(F.collect_list("item")), F.lit(after)).alias("payload")).select(F.col("source").alias("token"), F.upper("source").alias("company"), "payload")


def pages(docs: DataFrame, item: str, by: str = "source") -> DataFrame:
    """token, company, payload: a company's documents as one text a page."""
    rows = docs.select("source", F.floor(F.col("doc_id") / PAGE).alias("page"), F.struct("doc_id", F.expr(item).alias("x")).alias("x"))
    made = rows.groupBy("source", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda s: s["x"]), "\n").alias("payload"))
    return made.select(F.concat_ws("-", "source", F.col("page").cast("string")).alias("token"), F.upper("source").alias("company"), "payload")
