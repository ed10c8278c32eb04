"""A small catalog and three tables, for the flagship query and for tests."""

# fixed values: the catalog
CATALOG = r"""
{
 "types": [
  {
   "name": "Organization",
   "description": "A company, non-profit, or other formal organization.",
   "attributes": [
    {
     "name": "name",
     "datatype": "string",
     "required": true,
     "description": "Primary display name."
    },
    {
     "name": "website",
     "datatype": "string",
     "description": "Canonical website URL."
    },
    {
     "name": "founded_year",
     "datatype": "integer",
     "description": "Year the organization was founded."
    },
    {
     "name": "industry",
     "datatype": "string",
     "description": "Primary industry, free text."
    },
    {
     "name": "size",
     "datatype": "string",
     "description": "Size of the organization."
    }
   ],
   "relationships": [
    {
     "name": "headquartered_in",
     "range": "Place",
     "description": "Primary headquarters location."
    }
   ]
  },
  {
   "name": "Company",
   "description": "A company.",
   "attributes": [
    {
     "name": "name",
     "datatype": "string"
    },
    {
     "name": "url",
     "datatype": "string"
    },
    {
     "name": "year_started",
     "datatype": "integer"
    }
   ],
   "relationships": []
  },
  {
   "name": "Person",
   "description": "An individual person.",
   "attributes": [
    {
     "name": "full_name",
     "datatype": "string",
     "required": true,
     "description": "Full display name."
    },
    {
     "name": "email",
     "datatype": "string",
     "description": "Primary email address."
    },
    {
     "name": "title",
     "datatype": "string",
     "description": "Job title."
    },
    {
     "name": "data",
     "datatype": "string",
     "description": "Misc data."
    }
   ],
   "relationships": [
    {
     "name": "works_at",
     "range": "Organization",
     "description": "Employer."
    }
   ]
  },
  {
   "name": "Product",
   "description": "A physical or digital product sold by an organization.",
   "attributes": [
    {
     "name": "name",
     "datatype": "string",
     "required": true,
     "description": "Product name."
    },
    {
     "name": "sku",
     "datatype": "string",
     "description": "Stock-keeping-unit identifier."
    },
    {
     "name": "price_usd",
     "datatype": "number",
     "description": "Current list price in USD."
    },
    {
     "name": "launched_on",
     "datatype": "date",
     "description": "Public launch date."
    }
   ],
   "relationships": [
    {
     "name": "made_by",
     "range": "Organization",
     "description": "Manufacturer."
    }
   ]
  },
  {
   "name": "Place",
   "description": "A geographic place.",
   "attributes": [
    {
     "name": "name",
     "datatype": "string",
     "required": true,
     "description": "Place name."
    },
    {
     "name": "city",
     "datatype": "string"
    },
    {
     "name": "country",
     "datatype": "string"
    },
    {
     "name": "latitude",
     "datatype": "number"
    },
    {
     "name": "longitude",
     "datatype": "number"
    }
   ],
   "relationships": []
  },
  {
   "name": "Event",
   "description": "A scheduled public or private event.",
   "attributes": [
    {
     "name": "name",
     "datatype": "string",
     "required": true
    },
    {
     "name": "starts_on",
     "datatype": "date"
    },
    {
     "name": "ends_on",
     "datatype": "date"
    }
   ],
   "relationships": [
    {
     "name": "held_at",
     "range": "Place",
     "description": "Venue or host location."
    },
    {
     "name": "hosted_by",
     "range": "Organization",
     "description": "Organizing entity."
    }
   ]
  },
  {
   "name": "JobPosting",
   "description": "An open role advertised by an organization.",
   "attributes": [
    {
     "name": "title",
     "datatype": "string",
     "required": true,
     "description": "Role title as advertised."
    },
    {
     "name": "posted_on",
     "datatype": "date"
    },
    {
     "name": "salary_range",
     "datatype": "string",
     "description": "e.g. \"$120k-$150k\"."
    }
   ],
   "relationships": [
    {
     "name": "posted_by",
     "range": "Organization",
     "description": "Hiring organization."
    },
    {
     "name": "located_in",
     "range": "Place",
     "description": "Where the role is based."
    }
   ]
  }
 ]
}
"""

# fixed values: the tables, in order
TABLES = {
    "1_vendors.csv": """\
vendor,homepage_url,established,sector,hq_city,hq_country,employee_count
Acme Industrial Group,https://acmeindustrial.com,1987,Manufacturing,Cleveland,USA,540
Nordwind Logistics,https://nordwind-logistics.de,2004,Logistics,Hamburg,Germany,1230
Bluepeak Software,https://bluepeak.io,2016,Software,Austin,USA,88
Sakura Foods K.K.,https://sakurafoods.jp,1975,Food & Beverage,Osaka,Japan,2100
Helios Energy,https://heliosenergy.com,2009,Renewable Energy,Denver,USA,410
Verde Textiles,https://verdetextiles.com.br,1998,Textiles,Sao Paulo,Brazil,760
Kestrel Aerospace,https://kestrelaero.com,1994,Aerospace,Bristol,UK,1500
Lumen Health Labs,https://lumenhealthlabs.com,2019,Biotech,Boston,USA,52
""",
    "2_product_catalog.csv": """\
product_name,sku,manufacturer,msrp,warranty_months,distributor,country_of_origin
Volt 9 Cordless Drill,VD-0091,Acme Industrial Group,129.99,24,Toolhaus GmbH,USA
Volt 9 Impact Driver,VD-0112,Acme Industrial Group,149.99,24,Toolhaus GmbH,USA
Aurora 400W Solar Panel,AU-4001,Helios Energy,289.00,120,SunGrid Distribution,USA
TrailLite 2P Tent,TL-2200,Verde Textiles,199.50,12,Outdoor Collective,Brazil
Sakura Matcha Gift Set,SK-0455,Sakura Foods K.K.,42.00,,Umami Imports,Japan
Bluepeak Sync Hub,BP-7731,Bluepeak Software,349.00,36,Toolhaus GmbH,USA
Kestrel Nav Module,KA-9902,Kestrel Aerospace,1899.00,60,Direct,UK
""",
    "3_crm_export.csv": """\
_id,contact_name,company,email,status,date,notes,updated_at,Unnamed: 8
662f1a,Dana Whitfield,Acme Industrial Group,dana.w@acmeindustrial.com,active,2026-03-14,renewal call went well,2026-07-30T11:02:44Z,
662f1b,Kenji Mori,Sakura Foods K.K.,k.mori@sakurafoods.jp,churned,2025-11-02,moved to competitor,2026-07-30T11:02:44Z,
662f1c,Priya Natarajan,Bluepeak Software,priya@bluepeak.io,prospect,2026-06-21,met at ODSC booth,2026-07-30T11:02:44Z,
662f1d,Tom Becker,Nordwind Logistics,t.becker@nordwind-logistics.de,active,2026-01-09,,2026-07-30T11:02:44Z,
662f1e,Lucia Marino,Verde Textiles,lucia.marino@verdetextiles.com.br,prospect,2026-05-17,intro'd by Dana,2026-07-30T11:02:44Z,
662f1f,Sam Okafor,Helios Energy,s.okafor@heliosenergy.com,active,2026-02-27,pilot expanding,2026-07-30T11:02:44Z,
""",
}
