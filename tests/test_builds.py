"""Libraries of build files."""

from graphlake.sources import builds


def test_dependencies(spark):
    script = """
    plugins { id 'org.acme.pack' version '2.1' ; id("org.acme.other") version "3.0" }
    ext.taxVersion = '7.4'
    set('tillVersion', '1.9')
    dependencies {
      implementation 'org.acme:tax-core:${taxVersion}'
      api "org.acme:till:$tillVersion"
      api group: 'org.acme', name: 'ledger', version: '5.0'
      testImplementation "org.acme:bare"
      runtimeOnly "org.acme:odd:${unknown}"
    }
    """
    catalog = '[versions]\nrates = "4.2"\n[libraries]\nrates = { module = "org.acme:rates", version.ref = "rates" }\nplain = "org.acme:plain:1.0"\nparts = { group = "org.acme", name = "parts", version = "2" }\n[plugins]\np = { id = "org.acme.plug", version.ref = "rates" }\n'
    project = "<project xmlns='http://maven'><parent><groupId>org.acme</groupId><artifactId>base</artifactId><version>9</version></parent><properties><tax.version>7.5</tax.version></properties><dependencies><dependency><groupId>org.acme</groupId><artifactId>tax</artifactId><version>${tax.version}</version></dependency><dependency><groupId>org.acme</groupId><artifactId>free</artifactId></dependency></dependencies></project>"
    files = [("r", "a/build.gradle", "build.gradle", script), ("r", "gradle/libs.versions.toml", "libs.versions.toml", catalog), ("s", "pom.xml", "pom.xml", project), ("s", "bad/pom.xml", "pom.xml", "<project>"), ("s", "x.txt", "x.txt", script), ("t", "build.gradle", "build.gradle", "api 'org.acme:till:$tillVersion'"), ("t", "empty.gradle", "empty.gradle", None)]
    found = spark.createDataFrame([(r, p, f, bytearray(t.encode()) if t is not None else None) for r, p, f, t in files], "repo string, path string, file string, content binary")
    got = {(r.repo, r.name): r.version for r in builds.dependencies(found).collect()}
    assert got == {
        ("r", "org.acme.pack"): "2.1", ("r", "org.acme.other"): "3.0", ("r", "org.acme:tax-core"): "7.4", ("r", "org.acme:till"): "1.9", ("r", "org.acme:ledger"): "5.0", ("r", "org.acme:bare"): None, ("r", "org.acme:odd"): None,
        ("r", "org.acme:rates"): "4.2", ("r", "org.acme:plain"): "1.0", ("r", "org.acme:parts"): "2", ("r", "org.acme.plug"): "4.2",
        ("s", "org.acme:base"): "9", ("s", "org.acme:tax"): "7.5", ("s", "org.acme:free"): None, ("t", "org.acme:till"): None,
    }
    assert builds.dependencies(found.limit(0)).collect() == []


def test_versions_stay_in_their_scope(spark):
    pom = lambda v: f"<project><properties><x.version>{v}</x.version></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${{x.version}}</version></dependency><dependency><groupId>g</groupId><artifactId>p</artifactId><version>${{project.version}}</version></dependency></dependencies></project>"
    catalog = '[versions]\nr = "1"\nrich = { strictly = "9" }\n[libraries]\na = { module = "g:ref", version.ref = "r" }\nb = { module = "g:strict", version = { strictly = "2", prefer = "3" } }\nc = { module = "g:need", version = { require = "4" } }\nd = "g:line"\n[plugins]\ne = "p.id:5"\n'
    files = [
        ("r", "one/pom.xml", "pom.xml", pom("1.0")), ("r", "two/pom.xml", "pom.xml", pom("2.0")), ("r", "libs.versions.toml", "libs.versions.toml", catalog),
        ("r", "gradle.properties", "gradle.properties", "# no = 1\nledger = 6\nx.version=7\n"), ("r", "build.gradle", "build.gradle", "api \"g:ledger:${ledger}\"\next.versions = [boot: '8']\napi \"g:boot:${versions.boot}\""),
        ("r", "src/test/build.gradle", "build.gradle", "api 'g:only-in-tests:1'"),
    ]
    found = spark.createDataFrame([(r, p, f, bytearray(t.encode())) for r, p, f, t in files], "repo string, path string, file string, content binary")
    got = {(r.path, r.name): r.version for r in builds.dependencies(found).collect()}
    assert got == {
        ("one/pom.xml", "g:a"): "1.0", ("two/pom.xml", "g:a"): "2.0", ("one/pom.xml", "g:p"): None, ("two/pom.xml", "g:p"): None,
        ("libs.versions.toml", "g:ref"): "1", ("libs.versions.toml", "g:strict"): "2", ("libs.versions.toml", "g:need"): "4", ("libs.versions.toml", "g:line"): None, ("libs.versions.toml", "p.id"): "5",
        ("build.gradle", "g:ledger"): "6", ("build.gradle", "g:boot"): "8",
    }
