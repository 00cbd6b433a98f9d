"""Small original texts in the five languages, from which the classifiers of this package make their training rows."""

PROSE = {
    "en": """The café on the corner isn’t open yet – it’s being painted, and the façade looks naïve but cheerful.
He sent two résumés and asked for a “plain” answer… nobody replied before the end of the week.
We test every release before it goes out, and we write down what we have learned from it.
Pay starts at € 2 900 – 3 400 a month, that’s without the bonus; the temperature was 21 °C in the office.
She led a team of seven people who looked after the payment service of a large shop.
You will work closely with the designers, plan the next steps and answer questions from users.
The product is sold under the name Bluefin® and the older Harrow™ brand, © by its makers.
• Moved the archive to a new data centre and cut the cost of storage by half.
They had been working for several years on tools which help people find what they need.
This role is for someone who enjoys learning, can explain difficult things and does not give up.
I was responsible for the reports, the monthly figures and the training of new colleagues.""",
    "uk": """Ми шукаємо людину, яка вміє пояснювати складні речі простими словами та не боїться запитань.
Працював у команді з семи осіб, відповідав за звіти, щомісячні цифри і навчання нових колег.
Наш офіс розташований у центрі міста, поруч із парком, де влітку дуже гарно.
Об'єднали дві служби в одну, щоб користувачі отримували відповіді швидше, ніж раніше.
Вимоги: досвід роботи від трьох років, уважність, вміння планувати свій день.
Обов'язки: підтримка сервера, перевірка якості, спілкування із замовниками, написання інструкцій.
Ґанок був зачинений, проте ще є інший вхід; її подруга ждала біля їхнього під'їзду.
• Перенесли архів до нового центру обробки даних і зменшили витрати вдвічі.
Освіта: вища технічна, факультет прикладної математики. Мови: українська, англійська.
Цей фахівець знає, як організувати роботу, щоб нічого не загубилося й усе було вчасно.
Про себе: люблю вчитися, читаю книжки, їжджу на велосипеді та граю в шахи з друзями.
Після переходу на нову систему кількість помилок скоротилася, а швидкість зросла.""",
    "pl": """Szukamy osoby, która potrafi wyjaśnić trudne rzeczy prostymi słowami i nie boi się pytań.
Pracowałem w zespole siedmiu osób, odpowiadałem za raporty, miesięczne wyniki i szkolenie nowych kolegów.
Nasze biuro mieści się w środku miasta, obok parku, w którym latem jest bardzo ładnie.
Połączyliśmy dwie usługi w jedną, żeby użytkownicy szybciej otrzymywali odpowiedzi niż wcześniej.
Wymagania: doświadczenie od trzech lat, umiejętność planowania dnia, dobra znajomość języka.
Zażółć gęślą jaźń – mówiła babcia, gdy wnuki uczyły się pisać źródła i ćwiczenia.
• Przenieśliśmy archiwum do nowego ośrodka danych i zmniejszyliśmy koszty o połowę.
Będziesz współpracować z projektantami, planować następne kroki i odpowiadać na zgłoszenia.
O mnie: lubię się uczyć, czytam książki, jeżdżę na rowerze i gram w szachy z przyjaciółmi.
Po przejściu na nowy system liczba błędów spadła, a szybkość działania wzrosła dwukrotnie.""",
    "de": """Wir suchen jemanden, der schwierige Dinge mit einfachen Worten erklären kann und keine Fragen fürchtet.
Ich arbeitete in einer Gruppe von sieben Leuten und war für Berichte, Zahlen und Schulungen zuständig.
Unser Büro liegt mitten in der Stadt, neben einem großen Park, wo es im Sommer sehr schön ist.
Wir führten zwei Dienste zusammen, damit die Nutzer schneller Antworten bekommen als früher.
Anforderungen: mindestens drei Jahre Erfahrung, Sorgfalt, Überblick über den eigenen Tag.
• Übertragung des Archivs in ein neues Rechenzentrum; die Kosten sanken um die Hälfte.
Über mich: ich lerne gern, lese Bücher, fahre täglich Rad und spiele Schach mit Freunden.
Ähnliche Aufgaben übernahm später die Abteilung für Qualität, außerdem prüften wir Gemäß Öffnungsplan.
Nach der Umstellung auf das neue System fiel die Zahl der Fehler, während sich die Geschwindigkeit verdoppelte.
Die Straße ist heiß, süße Äpfel fallen, und das Mädchen grüßt höflich die Gäste.""",
    "es": """Buscamos a alguien que sepa explicar cosas difíciles con palabras sencillas y que no tema las preguntas.
Trabajé en un equipo de siete personas; me encargué de los informes, las cifras y la formación de compañeros.
Nuestra oficina está en el centro de la ciudad, junto a un parque donde en verano se está muy bien.
Unimos dos servicios en uno para que los usuarios recibieran las respuestas más rápido que antes.
Requisitos: experiencia mínima de tres años, atención, capacidad de planificar el día, inglés técnico.
• Trasladamos el archivo a un nuevo centro de datos y redujimos el coste a la mitad.
Sobre mí: me gusta aprender, leo libros, monto en bicicleta y juego al ajedrez con mis amigos.
¿Cuándo empezará el próximo año? ¡Ojalá mañana! El pingüino y la cigüeña miran al niño pequeño.
Tras el cambio al nuevo sistema, el número de errores bajó y la velocidad aumentó el doble.
Aquí también está la dirección: calle del Olmo, 12, 3º izquierda, a 1ª hora.""",
}

#: Ordinary sentences in languages beside the five, so that their letters count as clean text.
OTHER_PROSE = (
    "Hledáme zkušeného programátora, který umí řídit malý tým a připravit přehledné zprávy. Nabízíme příjemné prostředí, školení a pružnou pracovní dobu. Těšíme se na váš životopis, ať už jste odkudkoli z České republiky.",
    "Hľadáme skúseného vývojára, ktorý vie viesť menší tím a pripraviť prehľadné správy. Ponúkame školenia, príjemné prostredie a pružný pracovný čas v Košiciach.",
    "Iščemo izkušenega razvijalca, ki zna voditi manjšo ekipo in pripraviti poročila. Nudimo izobraževanja, prijetno okolje in možnost dela od doma. Tražimo iskusnog programera koji želi učiti i raditi s mladim timom, već od rujna.",
    "Nous recherchons un développeur expérimenté, prêt à gérer une petite équipe où l’on apprend beaucoup. Les tâches sont variées: conception, maîtrise de la qualité, suivi des fenêtres de mise à jour. Rédigé à l’été, cet œuvre reçut dès lors un écho très fort. Ça coûte peut-être plus, mais le résultat est là: sûr, complet et prêt à être livré.",
    "Procuramos um programador experiente que saiba gerir uma pequena equipa e preparar relatórios. Oferecemos formação, boas condições e horário flexível. Não é necessário viajar; as reuniões são às quartas. A solução já está em produção há três anos, com ótima avaliação dos usuários.",
    "Cerchiamo uno sviluppatore esperto, perché la qualità è la nostra priorità. Chi lavorerà da noi potrà crescere: la città è bella, l’età non conta, e così più libertà per tutti.",
    "Cautăm un programator cu experiență care știe să conducă o echipă mică și să pregătească rapoarte. Oferim instruire, condiții bune și program flexibil în orașul Iași, fără deplasări. Această funcție înseamnă și răspundere față de clienți.",
    "Vi söker en erfaren utvecklare som kan leda ett mindre lag och förbereda rapporter. Vi erbjuder utbildning, trevlig miljö och flexibel arbetstid på vårt kontor i Göteborg, även på distans. Åtgärder för säkerhet är också viktiga.",
    "Vi søger en erfaren udvikler, der kan lede et mindre hold og lægge klare planer. Vi tilbyder efteruddannelse, et godt miljø og fleksibel arbejdstid på vores kontor i Århus. Også nye øvelser hører til, når vi går i gang. Å være på laget vårt gjør jobben både lærerik og hyggelig; søk nå så får du svar før påske.",
    "Etsimme kokenutta kehittäjää, joka pystyy johtamaan pientä tiimiä ja hyväksymään myös pitkiä päiviä. Työ tehdään pääosin Jyväskylässä, ja sisältää täysin uusia tehtäviä. Otsime kogenud arendajat, kes räägib hästi eesti keelt ja õpib kiiresti; töökoht on Võrus, algus järgmisel kevadel. Öö ja päev.",
    "Tapasztalt fejlesztőt keresünk, aki tud vezetni egy kisebb csapatot és áttekinthető jelentéseket készít. Képzést, jó körülményeket és rugalmas munkaidőt kínálunk győri irodánkban. Fontos, hogy Ön önállóan is tudjon dolgozni, és jól beszéljen angolul.",
    "Deneyimli bir yazılım geliştirici arıyoruz; küçük bir ekibi yönetmeli ve açık raporlar hazırlamalı. Eğitim, güzel bir ortam ve esnek çalışma saatleri sunuyoruz. Şirketimiz İzmir’de, görüşmeler çevrim içi yapılır. Çağrı ve ölçüm işleri için güçlü iletişim şarttır.",
    "Meklējam pieredzējušu izstrādātāju, kurš prot vadīt nelielu komandu un gatavot pārskatus. Piedāvājam apmācību un elastīgu darba laiku Rīgā. Ieškome patyrusio kūrėjo, kuris moka vadyti nedidelę komandą ir ruošti ataskaitas; siūlome mokymus, gerą aplinką ir lankstų grafiką Šiauliuose, įskaitant žiemą.",
    "Við leitum að reyndum forritara sem getur stýrt litlum hópi og skrifað skýrslur. Við bjóðum námskeið, þægilegt umhverfi og sveigjanlegan vinnutíma á skrifstofu okkar í Reykjavík. Það þarf að þekkja íslensku og ensku, æskilegt er líka önnur reynsla.",
    "Chúng tôi tìm lập trình viên có kinh nghiệm, biết quản lý nhóm nhỏ và chuẩn bị báo cáo rõ ràng. Chúng tôi đào tạo, môi trường tốt và giờ làm việc linh hoạt tại Hà Nội. Ứng viên cần giao tiếp được bằng tiếng Anh.",
    "Αναζητούμε έμπειρο προγραμματιστή που μπορεί να διευθύνει μια μικρή ομάδα και να ετοιμάζει σαφείς αναφορές. Προσφέρουμε εκπαίδευση, καλό περιβάλλον και ευέλικτο ωράριο στο γραφείο μας στη Θεσσαλονίκη. Η γνώση αγγλικών είναι απαραίτητη, ενώ η εμπειρία μετράει.",
    "Ищем опытного разработчика, который умеет руководить небольшой командой и готовить понятные отчёты. Предлагаем обучение, хорошие условия и гибкий график. Объём работы разный, всё обсуждается; этот опыт вы сможете применить и дальше. Съёмка, подъезд, ещё и выходные дни.",
    "Търсим опитен разработчик, който може да ръководи малък екип и да подготвя ясни отчети. Предлагаме обучение, добри условия и гъвкаво работно време във Варна. Тражимо искусног програмера који уме да води мањи тим и прави јасне извештаје; нудимо обуку, добре услове и љубазно друштво, већ од јесени.",
)
